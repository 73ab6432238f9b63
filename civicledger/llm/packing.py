"""Best-fit packing of documents into sequences by bin completion.

Lengths are whole numbers up to the capacity, so what a packing needs to know of any corpus is a
histogram of at most `capacity` counts: Spark builds it, branch and bound plans on it, and Spark
deals the pieces to the plan's slots by their rank among pieces of equal length. Nothing that grows
with the corpus passes the driver.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicledger.llm.common import materialise
from civicledger.llm.tokens import ids_of, portions

CAPACITY = 4096
#: The id that ends every document.
END_ID = 1
#: Work of a bounded search: a node counts for as many as there are different lengths, a filling for its pieces; work=None searches to the end.
WORK = 400_000
#: Nodes of the search whose branches are kept open, which bounds the driver's memory.
LIVE = 16
#: Up to so many different lengths the lower bound looks at all its cases.
DETAILED = 1_500
#: Pieces for each group that is ranked by itself.
RANKED = 100_000


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """id_col, piece, start, length, ids (little-endian 32-bit), ids_crc32: each document's ids and END_ID, cut only beyond the capacity.

    Null and empty texts are the end id alone; null and repeated ids and repeated rows keep their rows.
    """
    id_type = docs.schema[id_col].dataType
    kind = f"`{id_col}` {id_type.simpleString()}, piece int, start long, length long, ids binary, ids_crc32 long"
    end = END_ID.to_bytes(4, "little")

    def cut(batches):
        for b in batches:
            for i, n in portions(b.column(1)):
                part = b.slice(i, n)
                out: list[list] = [[], [], [], [], [], []]
                for row, ids in enumerate(ids_of(part.column(1), tokenizer)):
                    ids += end
                    for k in range(-(-len(ids) // (4 * capacity))):
                        one = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                        for col, v in zip(out, (row, k, k * capacity, len(one) // 4, one, zlib.crc32(one))):
                            col.append(v)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(out[0])), *(pa.array(c, t) for c, t in zip(out[1:], types))], [id_col, "piece", "start", "length", "ids", "ids_crc32"])

    return docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text")).mapInArrow(cut, kind)


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with `row`, a number of their own each, to be written before they are packed."""
    return pieces.withColumn("row", F.monotonically_increasing_id())


def pack(pieces: DataFrame, capacity: int = CAPACITY, key_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (any columns, among them `length` from 1 to capacity) with sequence_id and offset.

    Pieces of one length are interchangeable, so ties need no rule; columns called sequence_id or
    offset are replaced. `pieces` is read twice and should be a written table. Pieces are dealt and
    ranked by key_cols: where many rows may share a key (null ids), give a row number (`numbered`).
    """
    from civicledger.llm.common import drop_columns_like

    spark = pieces.sparkSession
    pieces = drop_columns_like(pieces, ["sequence_id", "offset", "__salt", "__rank", "__from"])
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= k <= capacity for k in hist):
        raise ValueError("a piece is longer than the capacity, or empty")
    salts = max(64, sum(hist.values()) // RANKED)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*key_cols), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__from"))
    within = Window.partitionBy("length", "__salt").orderBy(*key_cols)
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1).join(starts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__from")).drop("__salt", "__from")
    slots = spark.sparkContext.broadcast(slot_table(plan(hist, capacity)))
    kept = [f for f in ranked.schema.fields if f.name != "__rank"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def place(batches):
        table = slots.value
        for b in batches:
            seq, off = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("__rank").to_pylist()):
                froms, rows = table[length]
                at, times, first, offsets = rows[bisect_right(froms, rank) - 1]
                seq.append(first + (rank - at) // times)
                off.append(offsets + (rank - at) % times * length)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*(f.name for f in kept), "sequence_id", "offset"])

    return ranked.mapInArrow(place, kind)


def slot_table(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int, int]]]]:
    """length -> (first ranks, [(first rank, pieces a sequence, first sequence, offset of the first piece)])."""
    used: dict[int, int] = {}
    table: dict[int, tuple[list, list]] = {}
    seq = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            m = pattern[length]
            froms, rows = table.setdefault(length, ([], []))
            froms.append(used.get(length, 0))
            rows.append((used.get(length, 0), m, seq, offset))
            used[length] = used.get(length, 0) + m * times
            offset += m * length
        seq += times
    return table


def plan(hist: dict[int, int], capacity: int, work: int | None = WORK) -> list[tuple[dict[int, int], int]]:
    """Fillings {length: count} with how many sequences take each; few sequences in all.

    Best fit decreasing is the first incumbent. While it is above the lower bound, bin completion
    searches for a packing with one sequence less, which becomes the incumbent. With work=None the
    search is exhaustive and the result a proven optimum; a bounded one (the problem is NP-hard) ends
    with the incumbent after so much work, and `lower_bound` tells how far from an optimum that can be.
    """
    hist = {k: v for k, v in hist.items() if v}
    best = best_fit_decreasing(hist, capacity)
    least = lower_bound(hist, capacity)
    while (count := sum(t for _, t in best)) > least:
        found = complete(hist, capacity, count - 1, work)
        if found is None:
            break
        best = found
    return best


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Sequences that any packing takes: Martello and Toth's L2, the sum's bound among its cases.

    For each k, pieces longer than capacity - k share a sequence with none of at least k; those of over half the capacity
    share one with none of each other; what pieces from k to half the capacity exceed their room by takes more.
    """
    lengths = sorted(hist)
    best = -(-sum(k * v for k, v in hist.items()) // capacity)
    for k in [0, *(x for x in lengths if 2 * x <= capacity)]:
        long = wide = wide_sum = small = 0
        for x in lengths:
            if x > capacity - k:
                long += hist[x]
            elif 2 * x > capacity:
                wide += hist[x]
                wide_sum += x * hist[x]
            elif x >= k:
                small += x * hist[x]
        best = max(best, long + wide + max(0, -(-(small - (wide * capacity - wide_sum)) // capacity)))
        if len(lengths) > DETAILED:
            break
    return best


def best_fit_decreasing(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    groups: dict[int, list[tuple[dict[int, int], int]]] = {capacity: []}
    rooms = [capacity]

    def put(pattern: dict[int, int], times: int, room: int) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        groups[room].append((pattern, times))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            i = bisect_right(rooms, length - 1)
            room = next((r for r in rooms[i:] if groups[r]), capacity)
            pattern, times = groups[room].pop() if groups[room] else ({}, left)
            m = min(room // length, left)
            use = min(times, left // m)
            if use < times and pattern:
                groups[room].append((pattern, times - use))
            put({**pattern, length: pattern.get(length, 0) + m}, use, room - m * length)
            left -= m * use
    return [p for g in groups.values() for p in g]


class Completion:
    """Bin completion, depth first: is there a packing into `bins` sequences?

    A state is the pieces that are left and the waste that may still be made (bins * capacity less the sum,
    less what was wasted). Each node takes the largest piece left and branches over the undominated fillings around it,
    least waste first, larger pieces first. States that have failed are remembered, so the order of equal choices
    isn't searched twice.
    """

    def __init__(self, capacity: int, work: int | None, descending: bool):
        self.capacity, self.work, self.descending = capacity, work, descending
        self.failed: set[tuple[int, int]] = set()
        self.visited = 0

    def fillings(self, lengths: list[int], left: list[int], room: int, slack: int):
        """Undominated fillings of the room, as lists of (index, count), with at most `slack` of waste; lengths are in falling order."""
        n = len(lengths)
        first = next((i for i in range(n) if lengths[i] <= room), n)
        reach = [1] * (n + 1)  # bit s of reach[i]: pieces from i on can fill exactly s
        mask = (2 << room) - 1
        for i in range(n - 1, first - 1, -1):
            bits, step, c = reach[i + 1], 1, min(left[i], room // lengths[i])
            while c:
                k = min(step, c)
                bits |= bits << (lengths[i] * k)
                c -= k
                step *= 2
            reach[i] = bits & mask

        def exact(i: int, target: int):
            if not target:
                yield []
                return
            places = [j for j in range(i, n) if lengths[j] <= target and left[j] and reach[j] >> target & 1]
            for j in places if self.descending else reversed(places):
                for k in range(min(left[j], target // lengths[j]), 0, -1):
                    if reach[j + 1] >> (target - k * lengths[j]) & 1:
                        for rest in exact(j + 1, target - k * lengths[j]):
                            yield [(j, k), *rest]

        # a piece of which not all can be in the filling fits into as much waste as its length: from there on all are dominated
        spare = min((length for length, k in zip(lengths, left) if k > room // length), default=room + 1)
        for waste in range(min(slack, room, spare - 1) + 1):
            if first < n and reach[first] >> (room - waste) & 1 or room == waste:
                for filling in exact(first, room - waste):
                    self.visited += 1 + len(filling)
                    if self.work is not None and self.visited > self.work:
                        return
                    if not self.dominated(filling, lengths, left, waste):
                        yield filling, waste

    def dominated(self, filling: list[tuple[int, int]], lengths: list[int], left: list[int], waste: int) -> bool:
        """Whether a piece left out could take the place of none, one or two of the filling's, leaving less waste, or as little with fewer pieces.

        Whatever the filling leaves to others, the other filling leaves the same or smaller pieces (Martello and Toth).
        """
        used = dict(filling)
        at = {length: i for i, length in enumerate(lengths)} if not waste else {}
        singles = [lengths[i] for i, _ in filling]
        pairs = {x + y for a, x in enumerate(singles) for b, y in enumerate(singles) if a < b or filling[a][1] > 1 and a == b}
        there = lambda i: left[i] > used.get(i, 0)
        if not waste:
            return any(x in at and there(at[x]) for x in pairs)
        falling = [-x for x in lengths]
        for x, least in [(0, 1), *((x, x + 1) for x in singles), *((x, x) for x in pairs)]:
            for i in range(bisect_left(falling, -x - waste), len(lengths)):
                if lengths[i] < least:
                    break
                if there(i):
                    return True
        return False

    def hopeless(self, lengths: list[int], left: list[int], slack: int) -> bool:
        """True if some piece can't be completed without more waste than may be made."""
        if slack >= lengths[-1]:
            return False
        bits = 1
        mask = (2 << self.capacity) - 1
        for length, c in zip(lengths, left):
            step = 1
            while c:
                k = min(step, c)
                bits |= bits << (length * k) & mask
                c -= k
                step *= 2
        window = (2 << slack) - 1
        return any(not bits >> max(0, self.capacity - length - slack) & window for length in lengths if self.capacity - length > slack)

    def search(self, hist: dict[int, int], bins: int) -> tuple[list | None, bool]:
        """(fillings with their numbers of sequences, or None; whether the search came to its end).

        One state is changed and changed back; a failed one is remembered as a sum of random numbers, one for each piece of a
        length. The branches of the deepest LIVE nodes are kept open; those above are opened again where the search returns to them.
        """
        slack = bins * self.capacity - sum(k * v for k, v in hist.items())
        if slack < 0:
            return None, True
        left = dict(sorted(hist.items(), reverse=True))
        draw = random.Random(7)
        number = {k: draw.getrandbits(96) for k in left}
        key = sum(number[k] * v for k, v in left.items())
        path: list[tuple[dict[int, int], int, int]] = []
        opened: list[list] = [[self.branches(left, slack), 0]]  # (branches or None, how many have been taken)
        while opened:
            node = opened[-1]
            if node[0] is None:
                node[0] = islice(self.branches(left, slack), node[1], None)
            step = next(node[0], None)
            if self.work is not None and self.visited > self.work:
                return None, False
            if step is None:
                self.failed.add((key, slack))
                opened.pop()
                if path:
                    pattern, times, waste = path.pop()
                    slack += waste
                    for k, m in pattern.items():
                        left[k] += m * times
                        key += number[k] * m * times
                continue
            node[1] += 1
            pattern, times, waste = step
            after = key - sum(number[k] * m * times for k, m in pattern.items())
            if (after, slack - waste) in self.failed:
                continue
            path.append(step)
            key, slack = after, slack - waste
            for k, m in pattern.items():
                left[k] -= m * times
            if not any(left.values()):
                return [(p, t) for p, t, _ in path], True
            self.visited += len(left)
            opened.append([self.branches(left, slack), 0])
            if len(opened) > LIVE:
                opened[-LIVE - 1][0] = None
        return None, True

    def branches(self, state: dict[int, int], slack: int):
        """(pattern, sequences, waste): each filling around the largest piece as often as it goes, then once. Lengths are in falling order."""
        lengths = [k for k, v in state.items() if v]
        left = [state[k] for k in lengths]
        if self.hopeless(lengths, left, slack):
            return
        largest = lengths[0]
        left[0] -= 1
        for filling, waste in self.fillings(lengths, left, self.capacity - largest, slack):
            pattern = {largest: 1}
            for i, k in filling:
                pattern[lengths[i]] = pattern.get(lengths[i], 0) + k
            most = min((left[0] + 1) // pattern[largest], *(left[i] // k for i, k in filling if i), slack // waste if waste else left[0] + 1)
            for times in (most, 1) if most > 1 else (1,):
                yield pattern, times, times * waste


def complete(hist: dict[int, int], capacity: int, bins: int, work: int | None = WORK) -> list[tuple[dict[int, int], int]] | None:
    """A packing into `bins` sequences, or None if there is none or none was found within the work.

    A bounded search is made twice, larger and smaller pieces first among fillings of equal waste.
    """
    for descending in (True, False) if work is not None else (True,):
        found, ended = Completion(capacity, work, descending).search(hist, bins)
        if ended:
            return found
    return None
