"""Exact near-duplicate classes: n-gram Jaccard join through a token-group matrix.

A document's set holds the hashes of its distinct runs of five words. Documents with equal sets are one class; the class
of a third of all documents is thus a map-side combined minimum. Between classes:

* Members are ordered by how usual they are (``levels``), then by hash, so lines that many texts share come last. Two sets with
  J >= t and the smaller of size m have at least f(m) = 1 + m // 20 members in common among their first
  |X| - ceil(t|X|) + f(|X|) members (their prefixes), for any monotone f and any one order of all members. Prefix members that
  no other document has are dropped (``exchange``); a class left with fewer than f needs no more work.
* Similar classes form a group. Its key is the first prefix member that is about as frequent as the class's median member or more,
  which copies of one text agree on: their edits are rarer, and a line that many texts share is only a few members.
* The token-group matrix has a row (token, group) for the union of the prefixes of a group's classes, with how many have the
  token and the sizes that occur. A class is counted against the rows of its own tokens, itself left out, which bounds its overlap
  with every set of the group; only groups that reach f are opened, of two groups only the larger from the smaller.
* Opening a group compares its queries with up to ``PIVOTS`` of its classes, in blocks of ``BLOCK`` queries. Two classes that
  link to one pivot are in one component whatever their own similarity, so only pairs without a common pivot are left, and
  those are counted all, block by block. A group of copies by the thousand costs a few comparisons per copy, and no link
  between components is lost.

Links are exact: sets of 64-bit hashes are intersected in full. Nulls, empty texts and texts without words link with
nothing; shorter texts have their whole word sequence as the only member. Rows without doc_id are left out, and of
repeated ids the largest text counts. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import components, one_per_id, part_of, stored, text_bytes
from tracewarden.llm.exchange import SENT, Layout, answered, bucket_hash, replies, sender, short
from tracewarden.llm.words import mixed, rolled, slices

SIZE = 5
PERCENT = 80  # J >= PERCENT / 100
SLACK = 20  # f(m) = 1 + m // SLACK
PIVOTS = 4
BLOCK = 500
SLOTS = 1 << 18  # counters of how many sets have a member, by its lowest bits
SHARES = 64  # in which the counters of all tasks are summed


def required(n, percent: int = PERCENT):
    """Least overlap of a set of ``n`` with a set that it links to; ``n`` a Column or an array."""
    return -((-percent * n) // 100)


def shingle_sets(s, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a slice, sorted by both."""
    at, prints = s.windows(size)
    row = s.text_of[at]
    counts = np.diff(s.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = np.array(
        [mixed(rolled(s.hashes[s.first[r] : s.first[r + 1]], int(counts[r])))[0] + np.uint64(counts[r]) for r in short], np.uint64
    )
    row, prints = np.r_[row, short], np.r_[prints, extra]
    order = np.lexsort((prints, row))
    row, prints = row[order], prints[order]
    if len(row):
        new = np.r_[True, (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])]
        row, prints = row[new], prints[new]
    return row, prints


def _sums(row: np.ndarray, prints: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two independent hashes) of each set."""
    n = np.bincount(row, minlength=count)
    a, b = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        a[row[starts]] = np.add.reduceat(mixed(prints), starts)
        b[row[starts]] = np.add.reduceat(bucket_hash(mixed(prints)), starts)
    return n, a, b


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n, a, b): size and 128-bit hash of each document's set. After these, without doc_id, a task's (share, counts)."""
    names = ["doc_id", "n", "a", "b", "share", "counts"]

    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(1), lower=True):
                row, prints = shingle_sets(s, size)
                seen += np.bincount(slots(prints), minlength=SLOTS)
                n, a, b = _sums(row, prints, len(s.first) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s.rows], pa.int64()), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names,
                )
        if seen.any():
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(SHARES, pa.int64())] * 4, pa.array(range(SHARES), pa.int32()),
                 pa.array([x.astype(np.uint32).tobytes() for x in seen.reshape(SHARES, -1)], pa.binary())], names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, a bigint, b bigint, share int, counts binary")


def slots(prints: np.ndarray) -> np.ndarray:
    return (prints & np.uint64(SLOTS - 1)).astype(np.int64)


def levels(counted: DataFrame) -> np.ndarray:
    """How usual the members of each slot are, from the (share, counts) of all tasks.

    Rare members are 0, those in about twice as many sets are one more. A counter holds all members of its slot: what it has above the
    median counter is a usual member when that is beyond chance. The order of members is the same for all sets whatever the levels are,
    so they decide how much is compared, never what is found.
    """

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for share, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[share] = sums.get(share, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["share", "counts"]
            )

    rows = counted.select("share", "counts").repartition("share").mapInArrow(run, "share int, counts binary").collect()
    if not rows:
        return np.zeros(SLOTS, np.uint8)
    sums = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["share"])])
    usual = np.median(sums)
    unit = 16 + 8 * np.sqrt(usual)
    return np.frexp(np.maximum(sums - usual, 0) // unit)[1].astype(np.uint8)


def prefix_length(n: np.ndarray, percent: int, slack: int) -> np.ndarray:
    return n - required(n, percent) + 1 + n // slack


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, slack: int = SLACK, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): class_id is the smallest doc_id with the same set."""
    docs = one_per_id(docs, "doc_id", "text")
    marked = stored(signatures(docs, size))
    marks, usual = marked.filter("doc_id IS NOT NULL").select("doc_id", "n", "a", "b"), levels(marked.filter("doc_id IS NULL"))
    reps = marks.filter("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    found = links(docs, reps.select("rep", "n"), size, percent, slack, pivots, usual)
    same = stored(components(found, "a", "b"))
    whole = reps.join(same, reps["rep"] == same["node"], "left").select("n", "a", "b", "rep", "component")
    keep = marks.join(whole, ["n", "a", "b"], "left")
    return keep.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
    )


def links(docs: DataFrame, reps: DataFrame, size: int = SIZE, percent: int = PERCENT, slack: int = SLACK, pivots: int = PIVOTS,
          usual: np.ndarray | None = None) -> DataFrame:
    """(a, b): links between class representatives that connect the same components as all links do. ``usual``: see ``levels``."""
    sets = stored(candidates(docs, reps, size, percent, slack, usual))
    members = grouped(sets.select("rep", "n", "prefix"), percent, slack)
    opened = stored(qualifying(members, percent, slack))
    members = members.select("rep", "grp")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("rep"), "rep"))
    chosen = stored(members.withColumn("slot", rank).filter(F.col("slot") <= pivots).select("grp", "rep", "slot"))
    linked = stored(compared(opened, chosen, sets.select("rep", "text"), size, percent))
    # Which pivots of a group a class links to, as bits; equal bits are one cell.
    bits = stored(linked.groupBy("rep", "grp").agg(F.sum(F.expr("shiftleft(1, slot - 1)")).alias("bits")))
    marked = lambda rows: rows.join(bits, ["rep", "grp"], "left").fillna(0, ["bits"])
    queries = stored(marked(opened.select("rep", "grp").join(chosen, ["rep", "grp"], "left_anti")))
    held = marked(members.join(chosen, ["rep", "grp"], "left_anti").join(stored(queries.select("grp").distinct()), "grp", "left_semi"))
    open_ = stored(queries.select("rep", "grp", "bits").unionByName(held.select("rep", "grp", "bits")).distinct())
    left = crossed(open_, sets.select("rep", "text"), size, percent)
    return linked.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).unionByName(left)


def crossed(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): edges that connect what links between cells of a group without a common pivot connect.

    Cells are cut into blocks, and a task counts the overlaps of one pair of blocks as a matrix product over the tokens that both
    have. It returns an edge per class, not its links, however many there are.
    """
    cells = stored(rows.groupBy("grp", "bits").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    pairs = cells.join(cells.select("grp", F.col("bits").alias("bits2"), F.col("blocks").alias("blocks2")), "grp")
    pairs = stored(pairs.filter((F.col("bits") <= F.col("bits2")) & (F.col("bits").bitwiseAND(F.col("bits2")) == 0)))
    here = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    same = F.col("bits") == F.col("bits2")
    first = rows.join(pairs, ["grp", "bits"]).withColumn("i", here("blocks"))
    first = first.withColumn("j", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(0), F.col("blocks2") - 1)))
    second = rows.withColumnRenamed("bits", "bits2").join(pairs, ["grp", "bits2"]).withColumn("j", here("blocks2"))
    second = second.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(same, F.col("j")).otherwise(F.col("blocks") - 1))))
    second = second.filter(~(same & (F.col("i") == F.col("j"))))
    keys = ["grp", "bits", "bits2", "i", "j"]
    dealt = first.select("rep", *keys, F.lit(0).alias("side")).unionByName(second.select("rep", *keys, F.lit(1).alias("side")))

    def run(table: pa.Table) -> pa.Table:
        reps, side = table["rep"].to_numpy(), table["side"].to_numpy()
        row, prints, n = whole_sets(table["text"], size)
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1) if (side == 1).any() or table["i"][0].as_py() != table["j"][0].as_py() or table["bits"][0].as_py() != table["bits2"][0].as_py() else x
        both = overlaps(row, prints, x, y, len(reps))
        link = 100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)
        link &= reps[x][:, None] != reps[y][None, :]
        most = np.iinfo(np.int64).max
        label = {int(r): int(r) for r in reps}
        left, right = reps[x].copy(), reps[y].copy()
        while link.any():  # lowest label along links, both ways, until it rests
            a = np.minimum(left, np.where(link, right[None, :], most).min(1))
            b = np.minimum(right, np.where(link, a[:, None], most).min(0))
            for ids, new in ((reps[x], a), (reps[y], b)):
                for r, v in zip(ids.tolist(), new.tolist()):
                    label[r] = min(label[r], v)
            a, b = (np.array([label[r] for r in ids.tolist()], np.int64) for ids in (reps[x], reps[y]))
            if (a == left).all() and (b == right).all():
                break
            left, right = a, b
        edges = sorted((r, v) for r, v in label.items() if r != v)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return dealt.join(texts, "rep").groupBy(*keys).applyInArrow(run, "a bigint, b bigint")


def overlaps(row: np.ndarray, prints: np.ndarray, x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Sizes of the intersections of the sets ``x`` with the sets ``y``."""
    out = np.zeros((len(x), len(y)), np.float32)
    at = [np.full(count, -1) for _ in range(2)]
    at[0][x], at[1][y] = np.arange(len(x)), np.arange(len(y))
    mine = [at[k][row] for k in range(2)]
    common = np.intersect1d(prints[mine[0] >= 0], prints[mine[1] >= 0])
    column = np.searchsorted(common, prints)
    known = (column < len(common)) & (common[np.minimum(column, len(common) - 1)] == prints) if len(common) else np.zeros(len(prints), bool)
    order = np.argsort(column[known], kind="stable")
    column, mine = column[known][order], [m[known][order] for m in mine]
    for start in range(0, len(common), 2048):
        part = slice(*np.searchsorted(column, (start, start + 2048)))
        halves = []
        for m, size in zip(mine, out.shape):
            dense, here = np.zeros((size, 2048), np.float32), m[part] >= 0
            dense[m[part][here], column[part][here] - start] = 1
            halves.append(dense)
        out += halves[0] @ halves[1].T
    return out.astype(np.int64)


def grouped(sets: DataFrame, percent: int, slack: int) -> DataFrame:
    """(rep, n, grp, k, prefix): the group of each class that still shares enough, with the size of the group."""
    tokens = sets.select("rep", "n", F.posexplode("prefix").alias("at", "token"))
    often = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    each = tokens.join(often, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "at", "token"))).alias("t"))
    each = each.filter(F.size("t") >= _need(F.col("n"), percent, slack))
    median = F.get("t", F.floor(F.size("t") / 2).cast("int"))["df"]
    usual = F.filter("t", lambda x: 2 * x["df"] >= median)
    key = F.array_min(F.transform(usual, lambda x: F.struct(x["at"], x["token"])))["token"]
    rows = stored(each.select("rep", "n", key.alias("grp"), F.transform("t", lambda x: x["token"]).alias("prefix")))
    return rows.join(stored(rows.groupBy("grp").agg(F.count("*").alias("k"))), "grp")


def _need(n: Column, percent: int, slack: int) -> Column:
    return 1 + F.floor(F.ceil(percent * n / 100) / slack)


def qualifying(members: DataFrame, percent: int, slack: int) -> DataFrame:
    """(rep, n, grp): the groups each class has to open."""
    tokens = members.select("rep", "n", "grp", "k", F.explode("prefix").alias("token"))
    matrix = stored(tokens.groupBy("token", "grp", "k").agg(
        F.count("*").alias("holders"), F.min("n").alias("low"), F.max("n").alias("high")))
    queries = tokens.select("rep", "n", "token", F.col("grp").alias("home"), F.col("k").alias("home_k"))
    own = (F.col("grp") == F.col("home")) & (F.col("holders") > 1)
    up = (F.col("grp") != F.col("home")) & (F.struct("home_k", "home") < F.struct("k", "grp"))
    fits = (100 * F.col("high") >= percent * F.col("n")) & (percent * F.col("low") <= 100 * F.col("n"))
    met = queries.join(matrix, "token").filter((own | up) & fits)
    bound = met.groupBy("rep", "n", "grp").agg(F.count("*").alias("bound"))
    return bound.filter(F.col("bound") >= _need(F.col("n"), percent, slack)).select("rep", "n", "grp")


def compared(opened: DataFrame, chosen: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(rep, grp, slot, pivot): the pivots of opened groups that the queries link to, from their whole sets."""
    blocks = stored(opened.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    asking = opened.join(chosen, ["rep", "grp"], "left_anti").select("rep", "grp").join(blocks, "grp")
    asking = asking.select("rep", "grp", F.lit(0).alias("slot"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    asked = chosen.join(blocks, "grp").select("rep", "grp", "slot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = asking.unionByName(asked).join(texts, "rep")

    def run(table: pa.Table) -> pa.Table:
        reps, slots = table["rep"].to_numpy(), table["slot"].to_numpy()
        first = int(table["block"][0].as_py()) == 0
        row, prints, n = whole_sets(table["text"], size)
        out = []
        for p in np.flatnonzero(slots > 0):
            mine = np.sort(prints[row == p])
            spot = np.minimum(np.searchsorted(mine, prints), len(mine) - 1)
            both = np.bincount(row[mine[spot] == prints], minlength=len(n))
            good = (100 * both >= percent * (n + n[p] - both)) & (reps != reps[p]) & ((slots == 0) | first)
            out += [(int(reps[q]), int(slots[p]), int(reps[p])) for q in np.flatnonzero(good)]
        columns = list(zip(*out)) or [[]] * 3
        grp = pa.array([table["grp"][0].as_py()] * len(out), pa.int64())
        return pa.table({"rep": pa.array(columns[0], pa.int64()), "grp": grp, "slot": pa.array(columns[1], pa.int32()),
                         "pivot": pa.array(columns[2], pa.int64())})

    return rows.groupBy("grp", "block").applyInArrow(run, "rep bigint, grp bigint, slot int, pivot bigint")


def whole_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the sets of a text column, and their sizes."""
    rows, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for s in slices(texts, lower=True):
        row, p = shingle_sets(s, size)
        rows.append(row + s.rows.start)
        prints.append(p)
    row = np.concatenate(rows)
    return row, np.concatenate(prints), np.bincount(row, minlength=len(texts))


def candidates(docs: DataFrame, reps: DataFrame, size: int, percent: int, slack: int, usual: np.ndarray | None = None) -> DataFrame:
    """(rep, n, prefix, text): classes that share enough of their prefix; ``prefix`` has only shared members, in order."""
    layout = Layout.of(text_bytes(docs), 0.25)
    sent = zlib.compress(np.zeros(SLOTS, np.uint8) if usual is None else usual)

    def prefixes(s, level):
        row, prints = shingle_sets(s, size)
        rank = level[slots(prints)]
        if rank.any():
            order = np.lexsort((rank, row))  # stable: by hash within a level
            prints = prints[order]
        n = np.bincount(row, minlength=len(s.first) - 1)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, prints, n, place < prefix_length(n, percent, slack)[row]

    def entries(ids, texts):
        level = np.frombuffer(zlib.decompress(sent), np.uint8)
        for s in slices(texts, lower=True):
            row, prints, n, early = prefixes(s, level)
            _, a, b = _sums(row, prints, len(n))
            # Equal sets of a slice need to be sent once, for their smallest id.
            mine = ids[s.rows]
            order = np.lexsort((mine, b, a))
            same = np.r_[False, (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])]
            once = np.zeros(len(n), bool)
            once[order[~same]] = True
            keep = early & once[row]
            yield len(s.data), (mine[row[keep]], bucket_hash(prints[keep]), short(prints[keep]))

    answers = replies(docs.select("doc_id", "text").mapInArrow(sender(entries, layout, True), SENT), layout, True)
    listed = answers.unionByName(
        reps.select(part_of("rep", layout.parts).alias("part"), "rep"), allowMissingColumns=True
    )

    def pick(ids, texts, told, table):
        wanted = np.array(table.column("rep").drop_null().to_pylist(), np.int64)
        level = np.frombuffer(zlib.decompress(sent), np.uint8)
        out = []
        for s in slices(texts, lower=True):
            mine = ids[s.rows]
            if not np.isin(mine, wanted).any():
                continue
            row, prints, n, early = prefixes(s, level)
            cuts = np.r_[0, np.cumsum(n)]
            least = 1 + required(n, percent) // slack
            for r in np.flatnonzero(np.isin(mine, wanted)):
                answer = told.get(int(mine[r]))
                if answer is None:
                    continue
                lead = prints[cuts[r] : cuts[r + 1]][early[cuts[r] : cuts[r + 1]]]
                lead = lead[np.isin(short(lead), answer[0])]
                if len(lead) >= least[r]:
                    out.append((int(mine[r]), int(n[r]), lead.view(np.int64), texts[s.rows.start + int(r)].as_py()))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({"rep": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()),
                         "prefix": pa.array(columns[2], pa.list_(pa.int64())), "text": pa.array(columns[3], pa.string())})

    return answered(docs, listed, layout, pick, "rep bigint, n bigint, prefix array<bigint>, text string")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document with its class, its component and the size of its set."""
    return classes(docs).select("doc_id", "n_shingles", "component_id", "class_id")
