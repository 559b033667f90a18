"""Exact n-gram Jaccard join by vertical partitioning (operator 3).

The global order of n-grams is the order of their hashes.  It is cut into k
fragments; two sets whose symmetric difference is below k agree on at least one
whole fragment, so sets meet only by the hashes of whole fragments.  k follows
from the similarity and the sizes, by size level; a set also joins the next
level where a larger partner could stand there.  k exceeds the largest difference
by a third, so two linked sets agree on a fourth of their fragments or so, and
common passages alone bring no sets together.

1. Equal sets become one class.
2. Classes that share fewer fragments with all others than a partner would share
   with them alone are left out; the rest are paired with the least class of each
   shared fragment, their hub (one pair per class and hub).  Partial overlaps are counted for each of eight
   vertical fragments apart and summed per pair.
   Those that don't link to it are paired with the least of themselves, in a few
   rounds, as long as they share enough fragments with the others that are left.
3. Two members of a hub in different components so far may still link: one that
   is linked to the hub and one that is near it, or two that the last round left.
   Their differences from the hub must then overlap, in what at least two members
   share, and that join has a prefix filter (differences that many members share
   come last), so a large group of near copies does not become all of its pairs.
   What remains is counted exactly.
4. Links become connected components.

No link between different components is lost: members of a hub that both link to
it, or to one another's component, are connected already, and all others that can
link are counted exactly.

Broadcasts hold ids or fragment hashes of up to common.BROADCAST_BYTES, measured
before; beyond that the same join is shuffled.  A bit table of shared signatures
(32 MB at most) only spares shuffles.  Hubs of many members, and groups of many
copies, are dealt over many tasks.

Null and empty texts have the empty set, which links with nothing.  Rows that
share an id count as one document.  Rows without id are alone in their
component (null).  An empty table gives no rows.  Columns are taken by name or
place, so that none can clash; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import few, forget, hot_keys, lists, map_arrow, named, salted, settle, written
from weft.llm.components import components
from weft.llm.words import U, cut, mix, pieces

#: Fragments in which partial overlaps are counted apart.
VERTICAL = 8
#: One fragment in SPARE beyond the largest difference: the more, the more
#: fragments of two linked sets agree, and the fewer n-grams each has.
SPARE = 3
#: Bits of the largest table of shared signatures, as a power of 2.
MOST_BITS = 28
#: Rounds of hubs before what is left is compared by differences.
ROUNDS = 3
#: Signatures are looked for in so many slices, one after another, so that only one
#: slice's shuffle is on disk at a time (a power of 2).
SLICES = 4


def levels(most: int = 1 << 40) -> np.ndarray:
    """First sizes of the size levels."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * 7 // 5)))
    return np.array(out, np.int64)


LEVELS = levels()


def sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each row's distinct n-gram hashes, sorted; a row of fewer words has its
    whole sequence as one n-gram."""
    w = cut(texts, fold=True)
    h = w.hashes()
    n = np.diff(w.first)
    wins, bounds = w.windows(h, width)
    out = [np.unique(wins[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    for short in range(1, width):
        if (n == short).any():
            runs, at = w.windows(h, short)
            for r in np.flatnonzero(n == short):
                out[r] = runs[at[r] : at[r + 1]]
    return out


def budget(total: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets of so many members together."""
    return total * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For a sorted set's level and, if it can have partners there, the next:
    (hashes of its fragments, how many of them it shares at least with any
    partner that stands there)."""
    n = len(s)
    if not n:
        return []
    own = int(np.searchsorted(LEVELS, n, "right")) - 1
    most = n * 100 // percent
    mixed, out = mix(s), []
    for level in (own, own + 1)[: 1 + (most >= LEVELS[own + 1])]:
        end = int(LEVELS[level + 1]) - 1
        d = budget(2 * end, percent)
        if not d:
            continue
        k = d + 2 + d // SPARE
        f = ((s >> U(32)) * U(k)) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        place = mix(np.arange(k, dtype=U) + U(level << 32))
        found = mix(np.add.reduceat(mixed, first) + place[f[first].astype(np.int64)])
        apart, empties = budget(n + min(most, end), percent), k - len(first)
        if empties >= k - apart:  # so many fragments are empty that they may be all that agrees
            empty = np.ones(k, bool)
            empty[f[first].astype(np.int64)] = False
            found = np.concatenate((found, mix(place[empty])))
        out.append((found, max(1, k - apart - empties)))
    return out


def _twice(rows: DataFrame) -> DataFrame:
    """(sig, hub): signatures of two sets and more, each with the least of them."""
    return rows.groupBy("sig").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("sig", "hub")


def _shared(rows: DataFrame) -> list[DataFrame]:
    """Tables (sig) of the signatures that two sets and more of rows (sig, rep) have,
    slice by slice."""
    out = []
    for k in range(SLICES):
        slot = F.shiftrightunsigned("sig", 65 - SLICES.bit_length())
        out.append(written(_twice(rows.where(slot == k) if SLICES > 1 else rows).select("sig")))
        settle(rows.sparkSession)
    return out


def _enough(rows: DataFrame) -> DataFrame:
    """The rows (rep, part, need, sig) of sets that have as many signatures there as
    they share with any partner at least."""
    sets = rows.groupBy("rep", "part", "need").agg(F.collect_set("sig").alias("sigs"))
    return sets.where(F.size("sigs") >= F.col("need")).select("rep", "part", "need", F.explode("sigs").alias("sig"))


def _bits(sigs: DataFrame) -> tuple[int, np.ndarray]:
    """(b, words): a table of 2**b bits, set where the first b bits of a signature
    point; eight bits a signature, 2**MOST_BITS (32 MB) at most."""
    bits = max(16, min(MOST_BITS, (8 * sigs.count()).bit_length()))
    slot = F.shiftrightunsigned("sig", 64 - bits)
    words = sigs.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(sig, {64 - bits}) & 63 as int))")).alias("set")).toArrow()
    table = np.zeros(1 << (bits - 6), U)
    table[words["word"].to_numpy()] = words["set"].to_numpy().view(U)
    return bits, table


def _overlaps(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared, gained, lost) for pairs (a, b): overlaps are counted
    by fragment and summed; gained: what a has and b hasn't, lost: what b has and
    a hasn't."""
    hubs = tokens.join(few(written(pairs.select(F.col("b").alias("id")).distinct())), "id", "left_semi")
    left = tokens.select(F.col("id").alias("a"), "v", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = hubs.select(F.col("id").alias("b"), "v", F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = salted(left.join(few(pairs), "a"), right, ["b", "v"], "inner", hot_keys(pairs, ["b"]))
    gather = lambda x, y: F.flatten(F.collect_list(F.array_except(x, y)))
    partial = [F.sum(F.size(F.array_intersect("ta", "tb"))).alias("shared"), gather("ta", "tb").alias("gained"), gather("tb", "ta").alias("lost")]
    return both.groupBy("a", "b", "na", "nb").agg(*partial)


def _linked(na: str, nb: str, shared: str, percent: int) -> Column:
    return F.expr(f"100 * {shared} >= {percent} * ({na} + {nb} - {shared})")


def _stars(kept: DataFrame, tokens: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(stars: a, its hub b, and how they compare; (a, b) whose a may still link to
    others of b's that aren't linked to b either).

    A round pairs the sets of each signature with the least of them.  What isn't
    linked to that hub goes on to the next round, without the hub and those linked
    to it, so that groups that only meet in a passage come apart.  Two sets that link
    and have not been told apart by a hub go on with all signatures that they share,
    so one that goes on with fewer than it needs leaves, too."""
    active, known, tables = kept, None, []
    for _ in range(ROUNDS):
        hubs = written(_twice(active))
        rows = written(active.join(few(hubs), "sig").where("rep <> hub").select("sig", "part", "need", F.col("rep").alias("a"), F.col("hub").alias("b")))
        pairs = rows.select("a", "b").distinct()
        pairs = written(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"))
        star = written(_overlaps(pairs, tokens).withColumn("linked", _linked("na", "nb", "shared", percent)).withColumn("size", F.expr("na + nb - 2 * shared")))
        known = star if known is None else known.union(star)
        apart = written(rows.join(known.where("linked").select("a", "b"), ["a", "b"], "left_anti").select("sig", "part", "need", "a", "b"))
        again = written(_twice(apart.select("sig", F.col("a").alias("rep"))).select("sig"))
        active = written(_enough(apart.join(few(again), "sig", "left_semi").withColumnRenamed("a", "rep")))
        forget(hubs, rows, pairs, again, *tables)
        tables = [apart, active]
        if not active.count():
            break
    last = active.select("sig", F.col("rep").alias("a"))
    still = written(apart.join(few(last), ["sig", "a"], "left_semi").select("a", "b").distinct())
    forget(*tables)
    return known, still


def _across(stars: DataFrame, still: DataFrame, joined: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b), if any, between members of one hub that the stars leave in different
    components: of one that is linked to the hub and one that isn't, and of two
    that `still` has.  Their differences from the hub must overlap."""
    share = f"{100 - percent}D / {100 + percent}"
    stars = stars.withColumn("most", F.expr(f"cast(floor({share} * (na + na * 100 div {percent})) as bigint)"))
    labels = lambda name: joined.select(F.col("id").alias(name), F.col("component").alias(f"c{name}"))
    placed = stars.join(few(labels("a")), "a", "left").join(few(labels("b")), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    placed = placed.join(few(still.withColumn("open", F.lit(True))), ["a", "b"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    reach = written(placed.where("linked").groupBy("b").agg(F.max("size").alias("reach"), F.max("na").alias("widest")))
    # How far from the hub a member may be that links to one of those linked to it.
    close = F.expr(f"ca <> cb and size - reach <= {share} * (na + widest)")
    judged = placed.join(few(reach), "b", "left").withColumn("close", ~F.col("linked") & F.coalesce(close, F.lit(False)))
    wanted = written(judged.where("close or open").groupBy("b").agg(F.count("*").alias("others")))
    if not wanted.count():
        return None
    members = judged.where("linked or close or open").join(few(wanted), "b")
    members = written(members.select("a", "b", "ca", "na", "nb", "size", "most", "linked", "open", "close", F.concat("gained", "lost").alias("beyond")))
    # What only one member has beyond the hub can't overlap; the rest comes rarest
    # first (any order that a hub's members share loses nothing).
    each = members.select("a", "b", F.explode("beyond").alias("x"))
    often = written(each.groupBy("b", "x").agg(F.count("*").alias("n")).where("n > 1"))
    ranked = each.join(few(often), ["b", "x"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("ranked"))
    known = members.drop("beyond").join(ranked.select("a", "b", F.col("ranked.x").alias("beyond")), ["a", "b"])
    # Prefixes, from the least overlap that a linked pair of members must have.
    tight = F.expr(f"floor((size + {share} * (nb - na)) / 2) + 1")
    needs = F.greatest(F.lit(1), F.expr("size - floor(most / 2)"), F.when(F.col("linked"), tight).otherwise(F.lit(1)))
    known = known.withColumns({"c": F.size("beyond"), "needs": needs}).withColumns({"small": F.greatest(F.col("c") - F.col("needs") + 1, F.lit(0)).cast("int"), "large": F.greatest(F.least(F.col("c"), F.expr("c - size + most + 1")), F.lit(0)).cast("int")})
    ordered = written(known.where("small > 0 or large > 0").select("a", "b", "ca", "na", "size", "c", "linked", "open", "close", "small", "large", "beyond"))

    def side(prefix: str, name: str, which: str) -> DataFrame:
        first = F.posexplode(F.slice("beyond", F.lit(1), F.col(prefix))).alias(f"{name}_at", "x")
        return ordered.where(which).select("b", first, *[F.col(c).alias(f"{name}_{c}") for c in ("a", "ca", "na", "size", "c")])

    def meet(small: str, large: str) -> DataFrame:
        meets = F.expr(
            f"(s_size < l_size or (s_size = l_size and s_a < l_a)) and s_ca <> l_ca "
            f"and {percent} * greatest(s_na, l_na) <= 100 * least(s_na, l_na) and l_size - s_size <= {share} * (s_na + l_na)"
        )
        met = side("small", "s", small).join(side("large", "l", large), ["b", "x"]).where(meets)
        return met.groupBy("b", "s_a", "l_a", "s_na", "l_na", "s_size", "l_size", "s_c", "l_c").agg(F.count("*").alias("met"), F.max("s_at").alias("s_at"), F.max("l_at").alias("l_at"))

    met = meet("linked", "close").union(meet("close", "linked")).union(meet("open", "open"))
    # Past the last element met, no more can be shared than the shorter rest has.
    enough = F.expr(f"met + least(s_c - s_at, l_c - l_at) - 1 >= (s_size + l_size - {share} * (s_na + l_na)) / 2")
    more = written(met.where(enough).select("b", "s_a", "l_a", "s_na", "l_na", "s_size", "l_size"))
    xs = lambda name: ordered.select("b", F.col("a").alias(f"{name}_a"), F.col("beyond").alias(f"{name}_x"))
    counted = xs("s").join(few(more), ["b", "s_a"]).join(xs("l"), ["b", "l_a"])
    # Their symmetric difference is that of their differences from the hub.
    apart = F.col("s_size") + F.col("l_size") - 2 * F.size(F.array_intersect("s_x", "l_x"))
    second = counted.withColumn("shared", F.expr("s_na + l_na") - apart).withColumn("shared", F.expr("shared div 2")).where(_linked("s_na", "l_na", "shared", percent))
    out = written(second.select(F.least("s_a", "l_a").alias("a"), F.greatest("s_a", "l_a").alias("b")).distinct())
    forget(reach, wanted, members, often, ordered, more)
    return out


def links(df: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(documents: id, n, component of its class's least id; links between class
    representatives: a, b; the tables that the first still reads), for rows with an
    id."""
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(named(id_col).alias("id"), named(text_col).alias("text")).where("id is not null")

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(1)):
            sets = sets_of(batch.column(1).slice(a, b - a), width)
            c1 = np.array([mix(s).sum(dtype=U) for s in sets], U).view(np.int64)
            c2 = np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], U).view(np.int64)
            levels = [signatures(s, percent) for s in sets]
            parts = [[x[i] if i < len(x) else (np.empty(0, U), 0) for x in levels] for i in (0, 1)]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(c1), pa.array(c2)]
            for part in parts:
                bounds = np.concatenate(([0], np.cumsum([len(x) for x, _ in part])))
                columns += [lists(pa.array(np.concatenate([x for x, _ in part]).view(np.int64)), bounds), pa.array([need for _, need in part], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["id", "n", "c1", "c2", "own", "own_need", "next", "next_need"])

    digests = written(map_arrow(base, digest, f"id {kind}, n bigint, c1 bigint, c2 bigint, own array<bigint>, own_need int, next array<bigint>, next_need int"))
    full = digests.where("n > 0")
    classes = written(full.groupBy("c1", "c2").agg(F.min("id").alias("rep")))
    # Copies of a set agree on c1, so they alone make no signature shared.
    rows = full.select(F.explode(F.concat("own", "next")).alias("sig"), F.col("c1").alias("rep"))
    slices = _shared(rows)
    shared = functools.reduce(DataFrame.union, slices)
    # A set with too few shared fragments has no partner.  First by a bit table, so
    # that most sets leave without a shuffle, then exactly; hubs are the least of the rest.
    bits, table = _bits(shared)
    held = df.sparkSession.sparkContext.broadcast(table)

    def promising(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, part, needs, found = [], [], [], []
        for k in (0, 1):
            column, need = batch.column(1 + 2 * k), batch.column(2 + 2 * k).to_numpy()
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            slot = values.view(U) >> U(64 - bits)
            hit = (held.value[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == U(1)
            total = np.concatenate(([0], np.cumsum(hit)))
            n = total[ends[1:]] - total[ends[:-1]]
            for r in np.flatnonzero((n >= need) & (need > 0)).tolist():
                a, b = ends[r], ends[r + 1]
                at.append(r)
                part.append(k)
                needs.append(int(need[r]))
                found.append(values[a:b][hit[a:b]])
        if at:
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(part, pa.int32()), pa.array(needs, pa.int32()), lists(pa.array(np.concatenate(found)), bounds)], ["id", "part", "need", "sigs"])

    hopeful = written(map_arrow(full.select("id", "own", "own_need", "next", "next_need"), promising, f"id {kind}, part int, need int, sigs array<bigint>"))
    narrow = written(digests.select("id", "n", "c1", "c2"))
    forget(digests)
    firsts = written(classes.select(F.col("rep").alias("id")).distinct())
    heads = hopeful.join(few(firsts), "id", "left_semi").select(F.col("id").alias("rep"), "part", "need", F.explode("sigs").alias("sig"))
    met = heads.join(few(shared), "sig", "left_semi")
    kept = written(_enough(met))
    involved = written(kept.select(F.col("rep").alias("id")).distinct())
    forget(hopeful, firsts, *slices)

    def fragments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(1)):
            ids, ns, vs, parts = [], [], [], []
            for r, s in enumerate(sets_of(batch.column(1).slice(a, b - a), width)):
                edges = np.searchsorted(s, np.arange(1, VERTICAL, dtype=U) << U(61))
                ids += [a + r] * VERTICAL
                ns += [len(s)] * VERTICAL
                vs += range(VERTICAL)
                parts += np.split(s.view(np.int64), edges)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(ns, pa.int64()), pa.array(vs, pa.int32()), lists(pa.array(np.concatenate(parts)), bounds)], ["id", "n", "v", "tokens"])

    texts = base.join(few(involved), "id", "left_semi")
    tokens = written(map_arrow(texts, fragments, f"id {kind}, n bigint, v int, tokens array<bigint>"))
    if tokens.count() > VERTICAL * involved.count():  # rows repeat an id: the least text stands for it
        forget(tokens)
        tokens = written(map_arrow(texts.groupBy("id").agg(F.min("text").alias("text")), fragments, f"id {kind}, n bigint, v int, tokens array<bigint>"))
    stars, still = _stars(kept, tokens, percent)
    found = written(stars.where("linked").select("a", "b").distinct())
    joined = components(found)
    more = _across(stars, still, joined, percent)
    if more:
        found = written(found.union(more).distinct())
        joined = components(found)
    forget(involved, tokens, kept)
    whole = classes.select("c1", "c2", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    whole = written(whole.select("c1", "c2", F.coalesce("component", "rep").alias("component")))
    forget(classes)
    placed = salted(narrow.where("n > 0"), whole, ["c1", "c2"], "left", hot_keys(narrow.where("n > 0"), ["c1", "c2"])).select("id", "n", "component")
    placed = placed.union(narrow.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return placed, found, [narrow, whole]


def keep_first(df: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df but for those whose component has a smaller id."""
    found, pairs, tables = links(df, percent, width, id_col, text_col)
    gone = written(found.where("component < id").select(F.col("id").alias("gone")).distinct())
    forget(pairs, *tables)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.join(few(gone), F.col(f"c{df.columns.index(id_col)}") == F.col("gone"), "left_anti").toDF(*df.columns)


def join(df: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id_col, n_shingles, component_id)."""
    found, pairs, _ = links(df, percent, width, id_col, text_col)
    forget(pairs)
    out = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    kind = df.schema[id_col].dataType.simpleString()

    def alone(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(1)):
            n = [len(s) for s in sets_of(batch.column(1).slice(a, b - a), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), batch.column(0).slice(a, b - a)], [id_col, "n_shingles", "component_id"])

    nameless = df.where(named(id_col).isNull()).select(named(id_col).alias("id"), named(text_col).alias("text"))
    return out.union(map_arrow(nameless, alone, f"`{id_col}` {kind}, n_shingles bigint, component_id {kind}"))
