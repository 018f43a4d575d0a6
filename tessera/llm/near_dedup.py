"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal
sets form a class, and one of them stands for it. Each class keeps its K smallest hashes.

Candidates: an inverted list is kept for every two retained values that follow each other.
In the hash order of two sets with similarity s, each place of the union is shared with
probability s; at 0.75, the chance that no two of the first 32 places in a row are shared
is 2e-8, and for sets that the sketch holds whole, two in a row are always shared.

1. Each list links its members to its smallest one (a star, linear in the list). Pairs
   whose union sketch estimates too small a similarity go; the others are verified on the
   full sets, made again from the texts. What is linked falls into components.
2. Lists that still hold several components: a short list gives all its pairs across
   components, filtered and verified likewise.
3. Long lists (common passages, very large groups) would give too many pairs. A member of
   COMMON_KEYS open long lists at most has all its other keys in step 2: at 0.75 the chance
   that a similar set shares none of those is below 4e-7. The other members (half of them is
   common text) are listed once more, by each retained value but those that the long lists show
   to be common; of these lists the short ones give all their pairs across components. At 0.75, six in seven values of the smaller set and three
   in four of the larger one are shared; a member that has EASY of its FIRST smallest values
   in short lists shares none of them with a chance below 1e-7.
4. Members that have less (whatever is rare in them is little) are compared with each
   other in full: a group that shares long lists is sorted by set size and dealt into
   blocks, and the blocks are compared two by two on full sets, each pair of blocks in a
   task of bounded size. Only links that join components come out.

No list is cut, and no partner is dropped. Only components are wanted, so pairs inside one
needn't be looked at. A list, class or component that a third of all documents share is no
hot key: see `with_sums`.

Defined results: texts with less words than a shingle are one shingle; a text without
words, or null, is linked with nothing; rows with one id are one document, linked as
each of its texts is; rows without id are linked with nothing and kept; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, lean, only, ranked, small_batches, stored, with_sums

K = 32
#: Members of a list up to which its pairs are listed; and members of a block.
SHORT, BLOCK = 64, 768
#: Long lists that a class may be in and still be found by its other keys.
COMMON_KEYS = 7
#: A class with so many of its smallest values in short lists is found through them.
EASY, FIRST = 12, 24
#: Of K union values, so many must be shared: at 0.75 fewer are with a chance of 1e-7.
LEAST_SHARED = 11
#: Keys of long lists whose values are left out of the lists by single values, at most: the most frequent ones, named in the plan.
KNOWN = 500
#: Partners that are compared with one set in one piece, on average.
DEAL = 64
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts; words keep their hashes, until there are many."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
        if len(self.known) > 100_000:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        h = np.array(out, np.uint64)
        n = min(self.size, len(h))
        if not n:
            return h
        rolled = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            rolled = rolled * ODD + h[i : len(h) - n + 1 + i]
        return np.unique(_mix(rolled))


def _sketches(size: int):
    def run(batches):
        of = Shingles(size)
        for b in batches:
            n, low, high, sketch = [], [], [], []
            for t in b.column("text"):
                s = of(t.as_py())
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                low.append(int.from_bytes(d[:8], "little", signed=True))
                high.append(int.from_bytes(d[8:], "little", signed=True))
                sketch.append((s[:K] ^ np.uint64(1 << 63)).view(np.int64))  # order of the bits as that of signed numbers
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "sketch"])

    return run


def _alike(n_a, n_b, percent: int):
    """Whether the sizes allow for the similarity."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch doesn't rule the similarity out."""
    pairs = stored(pairs)
    counts = stored(pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("c")))
    some = stored(only(classes.select("rep", "n", "sketch"), counts.select("rep"), "rep").join(counts, "rep"))
    side = lambda s: some.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"), F.col("c").alias(f"c_{s}"))
    total = 2 * pairs.count()
    both = with_sums(with_sums(pairs, side("a"), ["a"], "c_a", total), side("b"), ["b"], "c_b", total)
    both = both.withColumn("union", F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, K))
    shared = F.size(F.array_intersect("union", F.array_intersect("s_a", "s_b")))
    whole = (F.col("n_a") <= K) & (F.col("n_b") <= K) & (F.size(F.array_union("s_a", "s_b")) <= K)
    enough = F.when(whole, 100 * shared >= percent * F.size("union")).otherwise(shared >= LEAST_SHARED * F.size("union") / K)
    return both.where(enough & _alike(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: rep, text.

    Pairs with the same a meet in one task, where a's set is made once; an a with many
    partners is dealt over several tasks by them, some DEAL partners each.
    """
    pairs = stored(pairs)
    counts = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.ceil(F.count(F.lit(1)) / DEAL).alias("salts")))
    dealt = with_sums(pairs, counts, ["a"], "c", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    ids = stored(pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "rep"))
    texts = only(texts, ids, "rep")
    first = heads.join(texts, heads["a"] == texts["rep"]).select("a", "salt", F.lit(0).alias("turn"), F.col("rep").alias("b"), "text")
    others = dealt.join(texts, dealt["b"] == texts["rep"]).select("a", "salt", F.lit(1).alias("turn"), "b", "text")

    def compare(batches):
        of, at, heads = Shingles(size), None, []
        for batch in batches:
            a, b = [], []
            cols = [batch.column(c).to_pylist() for c in ("a", "salt", "turn", "b")]
            for i, (x, salt, turn, y) in enumerate(zip(*cols, strict=True)):
                if (x, salt) != at:
                    at, heads = (x, salt), []
                s = of(batch.column("text")[i].as_py())
                if turn == 0:
                    heads.append(s)
                elif any(_similar(h, s, percent) for h in heads):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = first.unionAll(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "turn")
    return stored(met.mapInArrow(lean(compare), "a long, b long"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: values that many sets hold by a product of 0/1 matrices, the others by their places."""
    cat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (lv, lr), (rv, rr) = cat(left), cat(right)
    values = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.float32)

    def known(v, r):
        at = np.minimum(np.searchsorted(values, v), max(0, len(values) - 1))
        ok = values[at] == v if len(values) else np.zeros(len(v), bool)
        return at[ok], r[ok]

    (lv, lr), (rv, rr) = known(lv, lr), known(rv, rr)
    n_left, n_right = np.bincount(lv, minlength=len(values)), np.bincount(rv, minlength=len(values))
    many = np.flatnonzero(n_left * n_right > 64)
    for i in range(0, len(many), 1024):
        number = np.full(len(values), -1)
        number[many[i : i + 1024]] = np.arange(len(many[i : i + 1024]))

        def table(v, r, rows, number=number, wide=len(many[i : i + 1024])):
            m = np.zeros((rows, wide), np.float32)
            ok = number[v] >= 0
            m[r[ok], number[v[ok]]] = 1
            return m

        out += table(lv, lr, len(left)) @ table(rv, rr, len(right)).T
    few = np.ones(len(values), bool)
    few[many] = False
    l_ok, r_ok = few[lv], few[rv]
    lv, lr, rv, rr = lv[l_ok], lr[l_ok], rv[r_ok], rr[r_ok]
    order = np.argsort(rv, kind="stable")
    rv, rr = rv[order], rr[order]
    start, size = np.searchsorted(rv, lv), n_right[lv]
    to = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    np.add.at(out, (np.repeat(lr, size), rr[to]), 1)
    return out


def _block_links(size: int, percent: int):
    """Links across components between two blocks of a group, no more than join them."""

    def run(table: pa.Table) -> pa.Table:
        of = Shingles(size)
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("side", "rep", "comp")], map(of, table.column("text").to_pylist()), strict=True), key=lambda r: r[:3])
        halves = {side: list(g) for side, g in groupby(rows, key=lambda r: r[0])}
        left = halves.get(0, [])
        right = halves.get(1, left)
        a, b = [], []
        if left and right:
            both = _overlaps([r[3] for r in left], [r[3] for r in right])
            n_l, n_r = (np.array([len(r[3]) for r in half]) for half in (left, right))
            c_l, c_r = (np.array([r[2] for r in half]) for half in (left, right))
            linked = (100 * both >= percent * (n_l[:, None] + n_r[None] - both)) & (c_l[:, None] != c_r[None]) & (both > 0)
            root: dict[int, int] = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = find(left[i][2]), find(right[j][2])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(left[i][1])
                    b.append(right[j][1])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (rep) with comp: the label of rep's component."""
    found = stored(components(edges))
    return rows.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(docs.mapInArrow(lean(_sketches(shingle)), "doc_id long, n long, d1 long, d2 long, sketch array<long>"))
    full = rows.where("n > 0 and doc_id is not null")
    reps = stored(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")))
    total = _sum(reps, "c")
    members = stored(with_sums(full.select("doc_id", "n", "d1", "d2", "sketch"), reps, ["d1", "d2"], "c", total).select("doc_id", "n", "sketch", "rep"))
    classes = stored(members.where("doc_id = rep").select("rep", "n", "sketch").distinct())
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")

    steps = F.zip_with(F.slice("sketch", F.lit(1), F.size("sketch") - 1), F.slice("sketch", F.lit(2), F.size("sketch")), lambda a, b: F.xxhash64(a, b))
    lists, listed = _lists(classes.where("n > 1").select("rep", "n", F.explode(steps).alias("key")))
    star = lists.where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    # An id with several texts stands in several classes and links them.
    spread = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi")
    same_id = members.select("doc_id", F.col("rep").alias("b")).join(spread, "doc_id").where("a != b").select("a", "b").distinct()
    edges = _verified(_promising(star, classes, percent), texts, shingle, percent)

    open_lists = _open(lists, edges, listed)
    more = _verified(_promising(_pairs(open_lists, percent), classes, percent), texts, shingle, percent)
    edges = stored(edges.unionAll(more).unionAll(same_id))

    long_ = _open(open_lists.where(F.col("c") > SHORT).drop("comp"), edges, listed)
    if not long_.isEmpty():
        asked = long_.groupBy("rep").agg(F.max("n").alias("n"), F.min("comp").alias("comp"), F.count(F.lit(1)).alias("m")).where((F.col("m") > COMMON_KEYS) | (F.col("n") <= K)).drop("m")
        asked = stored(asked.join(classes.select("rep", "n", "sketch"), ["rep", "n"]))
        known = _known_common(long_, asked)
        values, listed = _lists(_by_value(asked, known))
        more = _verified(_promising(_pairs(values, percent), classes, percent), texts, shingle, percent)
        edges = stored(edges.unionAll(more))
        often = values.where((F.col("place") < FIRST) & (F.col("c") > SHORT)).select("rep", "n", F.lit(1).alias("common"))
        early = asked.select("rep", "n", F.size(F.filter(F.slice("sketch", 1, FIRST), lambda v: v.isin(known))).alias("common")).where("common > 0")
        common = often.unionAll(early).groupBy("rep", "n").agg(F.sum("common").alias("common"))
        hard = common.where(F.least(F.col("n"), F.lit(FIRST)) - F.col("common") < EASY).select("rep").distinct()
        long_ = stored(long_.join(hard, "rep", "left_semi"))
        edges = stored(edges.unionAll(_across(_open(long_.drop("comp"), edges, listed), texts, shingle, percent)))

    # A class goes by its smallest id, and a component by its smallest class.
    found = stored(components(edges))
    of = stored(reps.groupBy("rep").agg(F.sum("c").alias("c")).join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "c", F.coalesce("label", "rep").alias("comp")))
    of = with_sums(members.select("doc_id", "rep"), of, ["rep"], "c", total)
    of = of.groupBy("doc_id").agg(F.min("comp").alias("component_id")).withColumnRenamed("doc_id", "id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(of, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _sum(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def _lists(keys: DataFrame) -> tuple[DataFrame, int]:
    """keys (rep, key, ...) that several have, with c, the length of the list, and first, its smallest rep; and how many rows these are."""
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("first")).where("c > 1"))
    total = _sum(shared, "c")
    return stored(with_sums(keys, shared, ["key"], "c", total)), total


def _known_common(lists: DataFrame, asked: DataFrame) -> list[int]:
    """Values that more than SHORT of the classes asked hold, as their long lists show: every member of a list holds both values of its key. Of those, the most frequent ones."""
    held = lists.join(asked.select("rep", "n").distinct(), ["rep", "n"], "left_semi").groupBy("key").agg(F.countDistinct("rep").alias("c"), F.min(F.struct("rep", "n")).alias("one"))
    keys = held.where(F.col("c") > SHORT).orderBy(F.col("c").desc(), "key").limit(KNOWN).select("key", "one.*")
    steps = F.zip_with(F.slice("sketch", F.lit(1), F.size("sketch") - 1), F.slice("sketch", F.lit(2), F.size("sketch")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(steps, lambda x: F.xxhash64(x["a"], x["b"]) == F.col("key"))
    return sorted({v for r in F.broadcast(keys).join(asked, ["rep", "n"]).select(both.alias("both")).collect() for x in r["both"] for v in x})


def _by_value(asked: DataFrame, known: list[int]) -> DataFrame:
    """A row (rep, n, comp, place, key) for each retained value that isn't known to be common: a known one's list is long, so it has no pairs to give."""
    places = F.transform("sketch", lambda v, i: F.struct(i.alias("place"), v.alias("key")))
    return asked.select("rep", "n", "comp", F.explode(F.filter(places, lambda x: ~x["key"].isin(known))).alias("x")).select("rep", "n", "comp", "x.place", "x.key")


def _open(lists: DataFrame, edges: DataFrame, total: int) -> DataFrame:
    """The lists that hold several components, with comp: the component of each member."""
    labelled = _labelled(lists, edges)
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("c").alias("many")).where("lo < hi").select("key", "many")
    return stored(with_sums(labelled, stored(mixed), ["key"], "many", total).drop("many"))


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs across components of short lists, but those that a list's star has had."""
    short = lists.where(F.col("c") <= SHORT)
    left = short.select("key", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), "first")
    right = short.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & _alike(F.col("n_a"), F.col("n_b"), percent))
    return pairs.select("a", "b").distinct()


def _across(lists: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links across components among the classes of long lists. lists: key, rep, n, first, comp."""
    spark = lists.sparkSession
    if lists.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    firsts = stored(lists.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("m")))
    group = stored(components(with_sums(lists.select("key", "rep"), firsts, ["key"], "m", _sum(firsts, "m")).select("a", F.col("rep").alias("b")).distinct()))
    rows = lists.groupBy("rep").agg(F.max("n").alias("n"), F.min("comp").alias("comp")).join(group.withColumnRenamed("id", "rep"), "rep")
    rows = ranked(rows.select("rep", "n", "comp", F.col("label").alias("grp")), ["grp"], [F.col("n").asc(), F.col("rep").asc()])
    rows = stored(rows.withColumn("block", F.floor((F.col("rank") - 1) / BLOCK)))
    blocks = stored(rows.groupBy("grp", "block").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi")))
    one = blocks.select("grp", *[F.col(c).alias(f"i_{c}") for c in blocks.columns[1:]])
    two = blocks.select("grp", *[F.col(c).alias(f"j_{c}") for c in blocks.columns[1:]])
    meet = one.join(two, "grp").where("i_block <= j_block").where(100 * F.col("i_n_hi") >= percent * F.col("j_n_lo"))
    meet = meet.where("least(i_c_lo, j_c_lo) < greatest(i_c_hi, j_c_hi)").select("grp", F.col("i_block").alias("i"), F.col("j_block").alias("j"))
    seats = meet.select("grp", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionAll(meet.where("i < j").select("grp", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    ids = stored(rows.select("rep").distinct())
    some = only(texts, ids, "rep").distinct()
    seated = seats.join(rows, ["grp", "block"]).join(some, "rep").select("grp", "i", "j", "side", "rep", "comp", "text")
    return seated.groupBy("grp", "i", "j").applyInArrow(_block_links(size, percent), "a long, b long")
