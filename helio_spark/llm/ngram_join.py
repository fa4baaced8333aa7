"""Near-duplicate documents: an exact Jaccard join on word n-grams, rarest first.

Documents with equal n-gram sets are one class. The document frequency of every
n-gram is counted exactly, with n-grams packed by hash range. An n-gram of one
class cannot be shared, so it fills its class's prefix without being sent on: a
class of which over a quarter is unique is done. The rest meet on their prefix
n-grams, under length and positional filters; a suffix filter and the full
intersection decide once per pair. Links within a group of near copies that is
already connected are not made: first every class is compared with one class at
each of its rarest shared n-grams, then only classes of different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.llm.components import connected
from helio_spark.llm.text import WHITE, mixed, word_slices
from helio_spark.session import materialize

#: Words of an n-gram; links have SHARE_OF intersection >= SHARE union.
N, SHARE, SHARE_OF = 5, 75, 100
#: n-grams in a hash range; share of a slice's documents, and of slices, that make an n-gram frequent.
RANGE_GRAMS, LOCAL, EVERYWHERE = 1_500_000, 0.05, 0.02
#: n-grams of a class at which it meets one other class before all others of other components.
FIRST = 12
#: Bits of a set's parity.
PARITY = 512
_LOW = np.uint64(2**48 - 1)
_FREQUENT = 255


def least_overlap(n: np.ndarray) -> np.ndarray:
    """The least intersection of a set of n with any set it is linked to."""
    return -(-n * SHARE // SHARE_OF)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text."""
    for first, _, words in word_slices(column, WHITE):
        gram, at = words.ngrams(n)
        for i in range(words.n_docs):
            yield first + i, np.unique(gram[at[i] : at[i + 1]])


def _class_of(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one, two = mixed(grams), mixed(grams ^ np.uint64(0x5851F42D4C957F2D))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


def document_classes(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, class, check, frequent): the set size and class of each text.

    ``frequent`` lists, at one row of each batch, the n-grams that many of the
    batch's documents have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, name, check, grams = [], [], [], []
            for _, s in _sets(batch.column(1), n):
                size.append(len(s))
                a, b = _class_of(s)
                name.append(a)
                check.append(b)
                grams.append(s)
            frequent: list = [None] * len(size)
            if grams:
                value, count = np.unique(np.concatenate(grams), return_counts=True)
                frequent[0] = value[count >= max(20, LOCAL * len(grams))].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(check, pa.int64()),
                 pa.array(frequent, pa.list_(pa.int64()))], ["id", "n", "class", "check", "frequent"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, class long, check long, frequent array<long>")


def _packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _shared_grams(docs: DataFrame, classes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(class, n, prefix, grams): classes that can have a link, with their shared n-grams, rarest first.

    ``prefix`` is how many of them belong to the prefix; ``n - size(grams)`` n-grams
    before them are in no other class.
    """
    total, batches_ = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("frequent")).first()
    ranges = int(total // RANGE_GRAMS) + 12
    many = [
        r[0]
        for r in classes.where("frequent is not null").select(F.explode("frequent").alias("g")).groupBy("g").count()
        .where(F.col("count") >= max(2, EVERYWHERE * batches_)).select("g").collect()
    ]  # bounded: by the two shares and the mean size of a document
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(many, np.int64).view(np.uint64)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            seen, names, grams, held = set(), [], [], []
            for _, s in _sets(batch.column(0), n):
                name = _class_of(s)[0]
                if len(s) and name not in seen:
                    seen.add(name)
                    names.append(name)
                    grams.append(s)
            if not names:
                continue
            names_ = np.array(names, np.int64)
            for a in range(0, len(names), 60_000):  # places within a blob take two bytes
                part, own = grams[a : a + 60_000], names_[a : a + 60_000]
                value = np.concatenate(part)
                place = np.repeat(np.arange(len(part)), [len(s) for s in part]).astype(np.uint16)
                row = ((value >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
                often = np.isin(value, frequent) if len(frequent) else np.zeros(len(value), bool)
                order = np.argsort(row, kind="stable")
                order = order[~often[order]]
                cut = np.searchsorted(row[order], np.arange(ranges + 1))
                for r in range(ranges):
                    if cut[r] < cut[r + 1]:
                        mine = order[cut[r] : cut[r + 1]]
                        used, place_ = np.unique(place[mine], return_inverse=True)
                        held.append((r, 0, _packed(value[mine]), place_.astype(np.uint16).tobytes(), own[used].tobytes()))
                hot = np.flatnonzero(often)
                if len(hot):  # not counted: sent on by class
                    by = (own[place[hot]].view(np.uint64) % np.uint64(ranges)).astype(np.int64)
                    for r in np.unique(by):
                        mine = hot[by == r]
                        held.append((int(r) + ranges, 1, _packed(value[mine]), row[mine].astype(np.uint32).tobytes(), own[place[mine]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*held), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                ["part", "kind", "gram", "place", "class"],
            )

    def count(table: pa.Table) -> pa.Table:
        """Frequencies of one hash range; what two classes or more have goes on by class."""
        r = table.column("part")[0].as_py()
        gram = np.concatenate([_unpacked(x.as_py()) for x in table.column("gram")])
        names = [np.frombuffer(x.as_py(), np.int64) for x in table.column("class")]
        if r >= ranges:
            rarity = np.full(len(gram), _FREQUENT, np.uint8)
            name = np.concatenate(names)
            row = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("place")]).astype(np.uint64)
        else:
            place = [np.frombuffer(x.as_py(), np.uint16) for x in table.column("place")]
            name = np.concatenate([c[p] for c, p in zip(names, place)])
            order = np.lexsort((name, gram))
            gram, name = gram[order], name[order]
            once = np.ones(len(gram), bool)
            once[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])  # a class may come from many tasks
            gram, name = gram[once], name[once]
            _, group, df = np.unique(gram, return_inverse=True, return_counts=True)
            df = df[group]
            gram, name, df = gram[df > 1], name[df > 1], df[df > 1]
            rarity = np.minimum(np.ceil(8 * np.log2(df)), _FREQUENT - 1).astype(np.uint8)
            row = np.full(len(gram), r, np.uint64)
        token = (gram & _LOW) | row << np.uint64(48)
        to = (name.view(np.uint64) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(ranges + 1))
        out = [
            (i, token[m].tobytes(), rarity[m].tobytes(), name[m].tobytes())
            for i in range(ranges)
            if len(m := order[cut[i] : cut[i + 1]])
        ]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["part", "gram", "rarity", "class"])

    counted = (
        docs.select(F.col(text_col).cast("string").alias("text"))
        .mapInArrow(spread, "part int, kind int, gram binary, place binary, class binary")
        .groupBy("part")
        .applyInArrow(count, "part int, gram binary, rarity binary, class binary")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            to = (name.view(np.uint64) % np.uint64(ranges)).astype(np.int64)
            rows = [(int(i), size[to == i].tobytes(), None, name[to == i].tobytes()) for i in np.unique(to)]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["part", "gram", "rarity", "class"])

    sizes = classes.where("n > 0").groupBy("class").agg(F.first("n").alias("n")).mapInArrow(
        pack, "part int, gram binary, rarity binary, class binary"
    )

    def gather(table: pa.Table) -> pa.Table:
        """Shared n-grams of each class of a range, for the classes that share enough."""
        size_name, size, name, token, rarity = [], [], [], [], []
        for g, r, c in zip(table.column("gram"), table.column("rarity"), table.column("class")):
            c = np.frombuffer(c.as_py(), np.int64)
            if r.as_py() is None:
                size_name.append(c)
                size.append(np.frombuffer(g.as_py(), np.int64))
            else:
                name.append(c)
                token.append(np.frombuffer(g.as_py(), np.int64))
                rarity.append(np.frombuffer(r.as_py(), np.uint8))
        out = {"class": [], "n": [], "prefix": [], "grams": [], "parity": []}
        if name and size_name:
            name, token, rarity = np.concatenate(name), np.concatenate(token), np.concatenate(rarity)
            size_name, size = np.concatenate(size_name), np.concatenate(size)
            order = np.lexsort((token, rarity, name))
            name, token = name[order], token[order]
            known, first, have = np.unique(name, return_index=True, return_counts=True)
            by = np.argsort(size_name)
            n = size[by][np.searchsorted(size_name[by], known)]
            for c, a, m, k in zip(known.tolist(), first.tolist(), have.tolist(), n.tolist()):
                # a frequent n-gram may have come once for each task
                own = token[a : a + m]
                own = own[np.sort(np.unique(own, return_index=True)[1])]
                need = -(-k * SHARE // SHARE_OF)
                if len(own) >= need:
                    out["class"].append(c)
                    out["n"].append(k)
                    out["prefix"].append(len(own) - need + 1)
                    out["grams"].append(own)
                    out["parity"].append(parity_of(own))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return counted.unionByName(sizes).groupBy("part").applyInArrow(
        gather, "class long, n long, prefix int, grams array<long>, parity array<long>"
    )


def parity_of(grams: np.ndarray) -> np.ndarray:
    """PARITY bits, as longs: how often, modulo 2, the n-grams hash to each place.

    What two sets have in common cancels, so sets whose bits differ at d places have at
    least d n-grams that only one of them has.
    """
    place = (mixed(grams.view(np.uint64)) % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(place, minlength=PARITY) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def suffix_may_match(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """False if two sorted arrays surely have fewer than ``need`` values in common.

    The middle value of one cuts both in two; a part of the intersection cannot be
    larger than the smaller of two matching parts.
    """

    def most(a, b, depth):
        if depth == 0 or not len(a) or not len(b):
            return min(len(a), len(b))
        mid = len(b) // 2
        at = int(np.searchsorted(a, b[mid]))
        hit = at < len(a) and a[at] == b[mid]
        return most(a[:at], b[:mid], depth - 1) + hit + most(a[at + hit :], b[mid + 1 :], depth - 1)

    return most(a, b, depth) >= need


def _verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose Jaccard is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i in range(batch.num_rows):
                x = np.sort(batch.column(4)[i].values.to_numpy())
                y = np.sort(batch.column(5)[i].values.to_numpy())
                both = int(na[i] + nb[i])
                need = -(-both * SHARE // (SHARE + SHARE_OF))
                ok = min(len(x), len(y)) >= need and suffix_may_match(x, y, need)
                if ok:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok = SHARE_OF * common >= SHARE * (both - common)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = grams.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    two = grams.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ga", "gb")
    return rows.mapInArrow(run, "a long, b long")


def _possible(na, nb, ia, ib):
    """Length filter and positional filter of two sizes and the places of a common n-gram."""
    need = F.ceil((na + nb) * SHARE / (SHARE + SHARE_OF))
    length = (F.least(na, nb) * SHARE_OF >= F.greatest(na, nb) * SHARE)
    return length & (1 + F.least(na - ia - 1, nb - ib - 1) >= need)


#: Linked sets of sizes a and b differ in at most (a + b) / 7 n-grams: (SHARE_OF + SHARE) / (SHARE_OF - SHARE).
SUM_OF_DIFFERENCE = (SHARE_OF + SHARE) // (SHARE_OF - SHARE)


def _parity_distance(a: str, b: str):
    """Places in which two parities differ."""
    words = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(PARITY // 64)]
    return sum(words[1:], words[0]).cast("long")


def links_and_components(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect all that is linked, and (node, component)."""
    grams = materialize(grams, "shared-grams")
    own = F.col("n") - F.size("grams")
    postings = materialize(
        grams.select("class", "n", own.cast("int").alias("own"), F.posexplode(F.slice("grams", 1, F.col("prefix")))).select(
            F.col("col").alias("gram"), F.col("class").alias("c"), "n", "own", (F.col("own") + F.col("pos")).alias("i")
        ),
        "postings",
    )
    # every class with one class, drawn by hash, of each of its rarest shared n-grams: near relatives meet there
    lead = postings.groupBy("gram").agg(
        F.min(F.struct(F.xxhash64("gram", "c").alias("h"), "c", "n", "i")).alias("lead"), F.count(F.lit(1)).alias("df")
    ).where("df > 1")
    star = postings.where(F.col("i") < F.col("own") + FIRST).join(lead, "gram").where(F.col("c") != F.col("lead.c"))
    star = star.where(_possible(F.col("n"), F.col("lead.n"), F.col("i"), F.col("lead.i")))
    pairs = star.select(F.least("c", "lead.c").alias("a"), F.greatest("c", "lead.c").alias("b")).distinct()
    links = materialize(_verified(pairs, grams), "links")
    parts = materialize(connected(links), "parts")
    # classes of different components, wherever a prefix n-gram has several
    named = postings.join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("p", F.coalesce("component", "c")).drop("component")
    open_ = named.groupBy("gram").agg(F.min("p").alias("p0"), F.max("p").alias("p1")).where("p0 <> p1").select("gram")
    # with their parities, which tell most sets apart that share a common passage only
    bits = grams.select(F.col("class").alias("c"), "parity")
    named = materialize(named.join(open_, "gram", "left_semi").join(bits, "c"), "open-postings")
    side = lambda k: named.select("gram", *[F.col(c).alias(f"{c}{k}") for c in ("c", "n", "own", "i", "p", "parity")])
    met = side("a").join(side("b"), "gram").where(
        (F.col("ca") < F.col("cb")) & (F.col("pa") != F.col("pb")) & _possible(F.col("na"), F.col("nb"), F.col("ia"), F.col("ib"))
        & (SUM_OF_DIFFERENCE * (_parity_distance("paritya", "parityb") + F.col("owna") + F.col("ownb")) <= F.col("na") + F.col("nb"))
    ).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    pairs = met.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialize(_verified(pairs, grams), "links")
    every = links.unionByName(more)
    return every, (parts if more.isEmpty() else connected(every))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable by links) of every row.

    Words are runs without ASCII white space, A-Z lower-cased; the set of a text
    holds its distinct n-word shingles, all its words if fewer. A null text and one
    without words has no links. Repeated rows and equal sets are one component. A
    null id takes part but names a component only if no member has an id.
    """
    classes = materialize(document_classes(docs, n, id_col, text_col), "classes")
    grams = _shared_grams(docs, classes, n, id_col, text_col)
    _, parts = links_and_components(grams)
    parts = parts.select(F.col("node").alias("class"), "component")
    named = classes.select("id", "n", "class").join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = materialize(named, "named")
    least = named.where("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    return named.join(least, "component", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )
