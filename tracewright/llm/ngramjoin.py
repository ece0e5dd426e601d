"""Exact Jaccard self-join of documents on five-word shingles by token-combination prefixes.

A token is a shingle hash.  Tokens are ordered by the number of distinct sets that hold them, rarest
first, and fall into frequency classes 1, 2 and 3; classes 2 and 3 are dealt by hash into small
subclasses.  A subclass of class k with m tokens in a set's prefix contributes max(0, m - k + 1)
units; the prefix is extended until its units exceed the tokens that a partner may lack.  Two sets
that reach the threshold then share k tokens of some subclass within both prefixes, so combinations
of k tokens are indexed: single tokens of the rare class, pairs and triples of the others.

Tokens held by one set only come first and can match nothing, so a set whose prefix they fill is
not indexed at all.  Counting goes through hash buckets: tokens travel as packed arrays of distinct
sets, each bucket's task finds the tokens of two sets or more and returns these alone.  A token that
many sets of one chunk hold is hot: its owners pass the bucket by, so a bucket gathers at most
``LOCAL_HOT`` owners of a token from each chunk, and hot tokens come last in the order of all sets.

Sharing a combination makes a candidate, and every link is verified on the whole sets.  Candidates
are first tested against one member of their group; members that this joins need no further test
among themselves, and postings of groups that are one component go before the next turn.  Pairs
across what is still apart, of sizes that can link, are tested at last, so no link between components
is lost and copies are never expanded into all pairs.  Before a pair is verified, an upper bound of its
overlap must reach the threshold: tokens that only one set holds are never shared, and the parity
bitmaps of two sets' shared tokens differ in at most as many bits as the sets differ in tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.arrow import pieces, trimmed
from tracewright.llm.common import Scratch, hold, partitions_for
from tracewright.llm.components import components
from tracewright.llm.shingles import mix, shingle_sets

#: Least similarity, in hundredths.
THRESHOLD = 75
#: Largest number of sets holding a token of class 1 and of class 2.
CLASS_1, CLASS_2 = 16, 256
#: Sets of fewer tokens index single tokens only: subclasses would leave them too few units.
SINGLES_BELOW = 8
#: Tokens of a set's size for each subclass of class 2 and 3.
PER_SUBCLASS = {2: 16, 3: 24}
BYTES_EACH = 4 << 20
#: The share of signatures in the first turn is one in so many; most turns with pivots; pairs a
#: posting below which all are tested at once.
SAMPLED, PIVOT_ROUNDS, PAIRS_PER_POSTING = 16, 1, 8
SALTS = 8
#: Tokens of the sets that a task packs at once, sets it remembers having sent, and sets of a chunk that make a token hot.
CHUNK_TOKENS, REMEMBERED_SETS, LOCAL_HOT = 1_000_000, 200_000, 64
#: The frequency of hot tokens: above all counted ones.
HOT = 2**32 - 1

#: What the overlap bound needs of a set: its number of shared tokens and their parity bitmap.
BOUNDS = ["s", *[f"b{i}" for i in range(8)]]
PACKED = "part int, kind int, doc_id {id}, key long, check long, n int, keys binary, counts binary, tokens binary, frequencies binary"


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a token set."""
    n = np.uint64(len(tokens))
    a, b = mix(np.array([tokens.sum() + n, (mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))).sum() + n]))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    n = max(map(len, columns.values()))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _rows_of_sets(tokens: np.ndarray, owner: np.ndarray, target: np.ndarray, names: np.ndarray, kind: int) -> dict[str, list]:
    """Packed rows, one per target, of tokens and the sets (places in ``names``) that hold them."""
    order = np.argsort(target, kind="stable")
    tokens, owner, target = tokens[order], owner[order], target[order]
    out: dict[str, list] = {"part": [], "kind": [], "keys": [], "counts": [], "tokens": []}
    cuts = np.flatnonzero(np.diff(target.astype(np.int64), prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(target)], strict=True):
        own = owner[a:b]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        out["part"].append(int(target[a]))
        out["kind"].append(kind)
        out["keys"].append(names[own[at]].tobytes())
        out["counts"].append(np.diff(at, append=len(own)).astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes())
        out["tokens"].append(tokens[a:b].tobytes())
    return out


def _counts(raw: bytes, n: int) -> np.ndarray:
    """Tokens of each of ``n`` sets of a packed row, of whichever width they were written with."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def _pack(schema: pa.Schema, parts: int, seed: int, local_hot: int):
    """Stage 1: sets to packed rows, one per bucket and chunk, and one membership row per document.

    A task sends each of its distinct sets once. Tokens that ``local_hot`` sets of a chunk hold are
    hot: the bucket is told so (kind 2), and their owners go past it to the sets' parts (kind 3, the
    part in ``n``), so that no bucket gathers the owners of a token that many sets hold."""

    def send(sets: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        tokens, names = np.concatenate(sets), np.array(keys, np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        ordered = np.sort(tokens)
        hot = np.unique(ordered[local_hot - 1 :][ordered[local_hot - 1 :] == ordered[: len(ordered) - local_hot + 1]]) if len(ordered) >= local_hot else ordered[:0]
        del ordered
        bucket_of = lambda t: ((t >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)
        if len(hot):
            is_hot = np.isin(tokens, hot)
            past = _rows_of_sets(tokens[is_hot], owner[is_hot], (names % parts)[owner[is_hot]], names, 3)
            past["n"], past["part"] = past["part"], [(i * 7919 + keys[0]) % parts for i in range(len(past["part"]))]
            yield _rows(past, schema)
            tokens, owner = tokens[~is_hot], owner[~is_hot]
            at = bucket_of(hot)
            flags = {"part": np.unique(at).tolist(), "kind": [], "tokens": []}
            for p in flags["part"]:
                flags["kind"].append(2)
                flags["tokens"].append(hot[at == p].tobytes())
            yield _rows(flags, schema)
        if len(tokens):
            yield _rows(_rows_of_sets(tokens, owner, bucket_of(tokens), names, 0), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngram-join")
        sent: set[int] = set()
        held: list[np.ndarray] = []
        names: list[int] = []
        total = row = 0
        for batch in batches:
            for piece in pieces(batch, limit=256 << 10):
                sets = shingle_sets(piece.column("text").to_pylist(), seed)
                keys = [set_key(s) if len(s) else (0, 0) for s in sets]
                n = [len(s) for s in sets]
                yield _rows({"part": [(row + i) % parts for i in range(len(sets))], "kind": [1] * len(sets), "doc_id": piece.column("doc_id").to_pylist(), "key": [k[0] for k in keys], "check": [k[1] for k in keys], "n": n}, schema)
                row += len(sets)
                for s, (k, _) in zip(sets, keys, strict=True):
                    if len(s) and k not in sent:
                        sent.add(k)
                        held.append(s)
                        names.append(k)
                        total += len(s)
                if total >= CHUNK_TOKENS:
                    yield from send(held, names)
                    held, names, total = [], [], 0
                    if len(sent) > REMEMBERED_SETS:
                        sent.clear()
        if held:
            yield from send(held, names)

    return run


def _unpack(held: dict[str, list[bytes]], *more: tuple[str, type]) -> tuple[np.ndarray, ...]:
    """Keys, tokens each, tokens and further columns of packed rows laid end to end."""
    counts = [_counts(c, len(k) // 8) for c, k in zip(held["counts"], held["keys"], strict=True)]
    return np.frombuffer(b"".join(held["keys"]), np.int64), np.concatenate(counts), *[np.frombuffer(b"".join(held[k]), t) for k, t in (("tokens", np.uint64), *more)]


def _count(schema: pa.Schema, parts: int):
    """Stage 2: within a bucket, tokens of two sets or more, packed again by the set's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {"keys": [], "counts": [], "tokens": []}
        flags: list[bytes] = []
        for batch in batches:
            kind = np.array(batch.column("kind").to_pylist())
            members = batch.filter(pa.array(kind == 1))
            if members.num_rows:
                yield members
            past = batch.filter(pa.array(kind == 3))
            if past.num_rows:
                hot = [np.full(len(t) // 8, HOT, np.uint32).tobytes() for t in past.column("tokens").to_pylist()]
                moved = {"part": past.column("n"), "kind": pa.array([0] * past.num_rows, pa.int32()), "n": pa.nulls(past.num_rows, pa.int32()), "frequencies": pa.array(hot, pa.binary())}
                yield pa.RecordBatch.from_arrays([moved.get(f.name, past.column(f.name)) for f in schema], schema=schema)
            flags += batch.filter(pa.array(kind == 2)).column("tokens").to_pylist()
            own = batch.filter(pa.array(kind == 0))
            for k in held:
                held[k] += own.column(k).to_pylist()
        if not held["keys"]:
            return
        keys, counts, tokens = _unpack(held)
        held.clear()
        # the same set from another task brings the same tokens
        order = np.argsort(keys, kind="stable")
        fresh = np.zeros(len(keys), bool)
        fresh[order[np.diff(keys[order], prepend=keys[order[0]] - 1) != 0]] = True
        hot = np.unique(np.frombuffer(b"".join(flags), np.uint64))
        # but it may lack tokens there that are hot: those count from every task
        live = np.repeat(fresh, counts)
        if len(hot):
            live |= np.isin(tokens, hot)
        tokens, owner = tokens[live], np.repeat(np.arange(len(keys), dtype=np.int32), counts)[live]
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        size = np.diff(start, append=len(tokens))
        if len(hot):
            size[np.isin(tokens[start], hot)] = HOT
        run_of = np.diff(start, append=len(tokens))
        frequency = np.repeat(np.minimum(size, HOT), run_of)
        shared = frequency > 1
        if not shared.any():
            return
        tokens, owner, frequency = tokens[shared], owner[shared], frequency[shared]
        part = (keys % parts)[owner]
        order = np.lexsort((owner, part))
        tokens, owner, frequency, part = tokens[order], owner[order], frequency[order], part[order]
        out = _rows_of_sets(tokens, owner, part, keys, 0)
        ends = np.cumsum([len(t) // 8 for t in out["tokens"]])
        out["frequencies"] = [f.astype(np.uint32).tobytes() for f in np.split(frequency, ends[:-1])]
        yield _rows(out, schema)

    return run


def _assemble(classes: tuple[int, int]):
    """Stage 3: every set's shared tokens together with its signatures; sets whose unshared tokens
    fill the prefix go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size: dict[int, int] = {}
        held: dict[str, list[bytes]] = {"keys": [], "counts": [], "tokens": [], "frequencies": []}
        for batch in batches:
            for kind, key, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True):
                if kind == 1:
                    size[key] = n
            for k in held:
                held[k] += [x for x in batch.column(k).to_pylist() if x is not None]
        if not held["keys"]:
            return
        keys, counts, tokens, frequencies = _unpack(held, ("frequencies", np.uint32))
        held.clear()
        names, owner = np.unique(keys, return_inverse=True)
        owner = np.repeat(owner, counts)
        order = np.lexsort((tokens, frequencies, owner))
        owner, tokens, frequencies = owner[order], tokens[order], frequencies[order]
        once = np.concatenate([[True], (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])])  # hot tokens come from every task
        owner, tokens, frequencies = owner[once], tokens[once], frequencies[once]
        ends = np.searchsorted(owner, np.arange(len(names) + 1))
        rows: list[tuple] = []
        for i, key in enumerate(names.tolist()):
            a, b = ends[i], ends[i + 1]
            if 100 * (b - a) >= THRESHOLD * size[key]:
                parity = np.packbits(np.bincount((tokens[a:b] >> np.uint64(13) & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1)
                sigs, ranks = signatures(size[key], tokens[a:b], frequencies[a:b].astype(np.int64), classes)
                rows.append((key, size[key], tokens[a:b].astype(np.int64), sigs.astype(np.int64), b - a + 1 - ranks, b - a, *parity.view(np.int64).tolist()))
            if len(rows) == 2000:
                yield _sets(rows)
                rows = []
        if rows:
            yield _sets(rows)

    return run


def _sets(rows: list[tuple]) -> pa.RecordBatch:
    lists = []
    for c in (2, 3, 4):
        bounds = np.concatenate([[0], np.cumsum([len(r[c]) for r in rows])]).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([r[c] for r in rows]))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), *lists, *[pa.array([r[c] for r in rows], pa.int64()) for c in range(5, 5 + len(BOUNDS))]], ["key", "n", "tokens", "sigs", "lefts", *BOUNDS])


def token_class(frequency: np.ndarray, classes: tuple[int, int] = (CLASS_1, CLASS_2)) -> np.ndarray:
    return 1 + (frequency > classes[0]) + (frequency > classes[1])


def signatures(n: int, tokens: np.ndarray, frequencies: np.ndarray, classes: tuple[int, int] = (CLASS_1, CLASS_2)) -> tuple[np.ndarray, np.ndarray]:
    """Indexed combinations of a set of ``n`` tokens, of which ``tokens`` are shared with other
    sets, in order of (frequency, token), and the units of the shortest prefix that holds each."""
    needed = n - -(-THRESHOLD * n // 100) + 1 - (n - len(tokens))
    if needed <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    level = n.bit_length() - 1
    levels = [level, level + 1] if 100 * n // THRESHOLD >= 2 << level else [level]
    found, ranks = [], []
    for level in levels:
        size = 1 << level
        kind = np.ones(len(tokens), np.int64) if size < SINGLES_BELOW else token_class(frequencies, classes)
        sub = np.zeros(len(tokens), np.int64)
        for k, each in PER_SUBCLASS.items():
            mine = kind == k
            sub[mine] = 1 + (tokens[mine] >> np.uint64(7)).astype(np.int64) % max(1, size // each)
        group = kind * (1 << 40) + sub
        # units: the j-th token of a subclass counts from j = k on
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.arange(len(tokens)) - np.repeat(first, np.diff(first, append=len(tokens)))
        units = np.cumsum(rank + 1 >= kind)
        length = int(np.searchsorted(units, needed)) + 1
        head, kind, group = tokens[:length], kind[:length], group[:length]
        found.append(mix(head[kind == 1] ^ np.uint64(0x1111111111111111)))
        ranks.append(units[:length][kind == 1])
        combined = np.flatnonzero(kind > 1)
        members: dict[int, list[int]] = {}
        for i in combined.tolist():
            members.setdefault(int(group[i]), []).append(i)
        for g, at in members.items():
            k = g >> 40
            if len(at) >= k:
                places = np.array(at)[np.argsort(head[at])]
                sorted_tokens = head[places]
                combos = np.array(list(combinations(range(len(at)), k)))
                code = np.full(len(combos), np.uint64(level * 8 + k), np.uint64)
                for j in range(k):
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + sorted_tokens[combos[:, j]])
                found.append(code)
                ranks.append(units[places[combos].max(axis=1)])
    codes, rank = np.concatenate(found), np.concatenate(ranks)
    order = np.lexsort((rank, codes))
    codes, rank = codes[order], rank[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else order
    return codes[first], rank[first]


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of set keys whose sets reach the threshold. Pairs of one often used ``a`` are
    spread over salts."""
    side = lambda c, t: sets.join(pairs.select(F.col(c).alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(t))
    left = side("a", "t_a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(left, ["a", "salt"]).join(side("b", "t_b"), "b")
    common = F.size(F.array_intersect("t_a", "t_b"))
    return both.where(100 * common >= THRESHOLD * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _possible(prefix: str) -> Column:
    """Whether the set in the plain columns and the one in the prefixed columns can reach the threshold."""
    other = lambda c: F.col(prefix + c)
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(other(b))) for b in BOUNDS[1:]), F.lit(0))
    twice = F.least(2 * F.least(F.col("s"), other("s")), F.col("s") + other("s") - apart)
    return (100 + THRESHOLD) * twice >= 2 * THRESHOLD * (F.col("n") + other("n"))


def _plausible(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Distinct pairs whose bounds let them reach the threshold; bounds are looked up once for each."""
    other = bounds.select(*[F.col(c).alias(f"o_{c}") for c in bounds.columns])
    both = pairs.select("a", "b").distinct().join(bounds, F.col("b") == F.col("key")).join(other, F.col("a") == F.col("o_key"))
    return both.where(_possible("o_")).select("a", "b")


def _joined(labels: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels after new links: the components of the graph whose nodes are the old labels."""
    at = lambda c: F.coalesce(F.col(f"{c}_label"), F.col(c))
    ends = found
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
    new = components(ends.select(at("a").alias("a"), at("b").alias("b")), scratch, name)
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.write(moved.unionByName(new), f"{name}-labels")


def _size_class() -> Column:
    """Sets that can link have equal or neighbouring classes, since their sizes differ by 4/3 at most."""
    return F.floor(F.log(100 / THRESHOLD, F.col("n")) + F.lit(1e-9)).cast("int")


def _all_pairs(apart: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs of one signature, of different labels, whose bounds let them reach the threshold, each once.
    One of the two always lies outside the signature's most frequent label. The join judges the bounds,
    so it makes no rows of pairs that cannot link."""
    rows = apart.select("sig", "key", "label", "major").join(bounds, "key").withColumn("size", _size_class())
    low = rows.where("label != major").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    high = rows.select("sig", "size", *[F.col(c).alias(f"o_{c}") for c in ("label", *bounds.columns)])
    once = (F.col("label") != F.col("o_label")) & ((F.col("o_label") == F.col("major")) | (F.col("key") < F.col("o_key")))
    met = low.join(high, ["sig", "size"]).where(once & _possible("o_"))
    return met.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b"))


def _live(named: DataFrame) -> DataFrame:
    """Postings (sig, key, n, s, left, label) that can link within their signature to a set of another label.

    Two sets that share ``o`` tokens share a signature within the shortest prefixes of more units than the shared
    tokens they lack, s - o each. A signature that appears at unit r thus stands for links of o <= s + 1 - r =
    ``left`` alone: a link that needs more has another signature. So a link within the signature needs
    ``reach`` of each, that is (100 + THRESHOLD) left - THRESHOLD n, to be THRESHOLD times the other's size
    or more. A posting is
    held against the largest reach and the smallest size among the other labels of its signature;
    these come from one row for each signature and label, far fewer than postings where copies meet."""
    named = named.select("*", ((100 + THRESHOLD) * F.col("left") - THRESHOLD * F.col("n")).alias("reach"))
    sides = named.groupBy("sig", "label").agg(F.max("reach").alias("far"), F.min("n").cast("long").alias("small"))
    by_far, by_small = (Window.partitionBy("sig").orderBy(c, "label") for c in (F.desc("far"), F.asc("small")))
    best = lambda c, by: F.when(F.row_number().over(by) == 1, F.lead(c).over(by)).otherwise(F.first(c).over(by))  # noqa: E731  of the other labels
    sides = sides.select("sig", "label", "far", "small", best("far", by_far).alias("o_far"), best("small", by_small).alias("o_small"))
    sides = sides.where((F.col("far") >= THRESHOLD * F.col("o_small")) & (F.col("o_far") >= THRESHOLD * F.col("small"))).drop("far", "small")
    able = (F.col("reach") >= THRESHOLD * F.col("o_small")) & (F.col("o_far") >= THRESHOLD * F.col("n").cast("long"))
    return named.join(sides, ["sig", "label"]).where(able).select("sig", "key", "n", "s", "left", "label")


def set_components(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of the similarity components over set keys; nodes that are labels are left out.

    A first turn over a sixteenth of the signatures joins most copies. Then every turn keeps only the
    postings that can still link to a set of another label in their signature, tests one set of each such
    signature, a pivot of its rarest label, against its others, and drops the pivot's posting. Once
    the pairs across labels are few beside the postings, all of them are tested."""
    bounds = sets.select("key", "n", *BOUNDS)
    own = sets.select("key", "n", F.col("s").cast("int").alias("s"), "sigs", "lefts")
    share = (F.col("s") * 1000 / F.col("n")).cast("int")

    def test(pairs: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
        pairs = scratch.write(pairs, f"{name}-pairs")
        found = scratch.write(verify(pairs, sets), f"{name}-links")
        scratch.drop(f"{name}-pairs")
        if labels is None:
            return components(found, scratch, name)
        return labels if found.isEmpty() else _joined(labels, found, scratch, name)

    few = own.select("key", share.alias("share"), F.explode(F.filter("sigs", lambda x: x.bitwiseAND(F.lit(SAMPLED - 1)) == 0)).alias("sig"))
    pivots = few.groupBy("sig").agg(F.max(F.struct("share", "key"))["key"].alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    labels = test(_plausible(few.join(pivots, "sig").where("key != a").select("a", F.col("key").alias("b")), bounds), None, "turn-0")
    postings = own.select("key", "n", "s", F.explode(F.arrays_zip("sigs", "lefts")).alias("p")).select("key", "n", "s", F.col("p.lefts").alias("left"), F.col("p.sigs").alias("sig"))
    group = Window.partitionBy("sig")
    for turn in range(1, PIVOT_ROUNDS + 2):
        named = postings.join(labels, postings["key"] == labels["node"], "left").select("sig", "key", "n", "s", "left", F.coalesce("label", "key").alias("label"))
        named = _live(named)
        seen = named.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("sig", "label")))
        seen = seen.select("*", F.max(F.struct("c", "label")).over(group).alias("x"), F.max(F.struct(-F.col("c"), share, F.col("key").alias("key"), F.col("label").alias("label"))).over(group).alias("p"), F.count(F.lit(1)).over(group).alias("m"))
        apart = scratch.write(seen.where("x.c < m").select("sig", "key", "n", "s", "left", "label", F.col("x.label").alias("major"), F.col("p.key").alias("pivot"), F.col("p.label").alias("pivot_label"), (F.col("m") - F.col("c")).alias("others")), f"apart-{turn}")
        scratch.drop(f"apart-{turn - 1}")
        n, others = apart.agg(F.count(F.lit(1)), F.coalesce(F.sum("others"), F.lit(0))).first()
        if not n:
            break
        if others <= 2 * PAIRS_PER_POSTING * n or turn > PIVOT_ROUNDS:
            labels = test(_all_pairs(apart, bounds).distinct(), labels, f"turn-{turn}")
            break
        labels = test(_plausible(apart.where("label != pivot_label").select(F.col("pivot").alias("a"), F.col("key").alias("b")), bounds), labels, f"turn-{turn}")
        postings = apart.where("key != pivot").select("key", "n", "s", "left", "sig")
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, classes: tuple[int, int] = (CLASS_1, CLASS_2), local_hot: int = LOCAL_HOT) -> DataFrame:
    """Every row with its class: doc_id, n_shingles and component_id, the smallest id reachable
    by links of similarity 0.75 or more.

    Null and empty texts and texts of white space have no shingles and stay alone; equal texts and
    repeated rows share a class; sets that tie as pivots are told apart by their digests, which changes
    no class; null ids take part but never name a class, unless a class has no other; an empty table gives an empty result; other columns are ignored. A very long text is
    one set like others. ``classes`` are the largest frequencies of classes 1 and 2.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    parts = partitions_for(docs.select(id_col, text_col), BYTES_EACH)
    with Scratch(docs.sparkSession, "ngram-join") as scratch:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        id_type = docs.sparkSession.createDataFrame([], f"doc_id {kind}").toArrow().schema.field("doc_id").type
        text = PACKED.format(id=kind)
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", id_type), ("key", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("keys", "counts", "tokens", "frequencies")]])
        packed = rows.mapInArrow(trimmed(_pack(schema, parts, seed, local_hot)), text).repartitionById(parts, "part")
        counted = scratch.write(packed.mapInArrow(trimmed(_count(schema, parts)), text), "counted")
        scratch.drop()
        members = counted.where("kind = 1").select("doc_id", "key", "check", "n")
        held = scratch.write(members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2")), "held")
        clash = not held.where("c1 != c2").isEmpty()
        if not clash:
            names = held.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "key", "n", *[F.lit(None).cast("binary").alias(c) for c in ("keys", "counts", "tokens", "frequencies")])
            shared = counted.where("kind = 0").select("part", "kind", F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("n"), "keys", "counts", "tokens", "frequencies")
            sets = shared.unionByName(names).repartitionById(parts, "part").mapInArrow(trimmed(_assemble(classes)), "key long, n int, tokens array<long>, sigs array<long>, lefts array<long>, " + ", ".join(f"{c} long" for c in BOUNDS))
            sets = scratch.write(sets, "sets")
            scratch.drop()
            labels = set_components(sets, scratch)
            named = held.join(labels, held["key"] == labels["node"], "left").select("key", "least", F.coalesce("label", "key").alias("label"))
            best = named.groupBy("label").agg(F.min("least").alias("component_id"))
            named = named.join(best, "label").select("key", "component_id")
            out = members.join(named, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
            return scratch.keep(out, "result")
    return near_duplicates(docs, id_col, text_col, seed + 1, classes, local_hot)  # two sets with one key: hash anew


NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, array_to_string(list_slice(ws, s, s + 4), ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.component_id, w.doc_id) AS BIGINT) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id
LEFT JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON w.doc_id = c.node
"""
