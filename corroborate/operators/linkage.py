"""Merging, linking and matching of records, as DataFrame transforms."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import text as T

REVIEW = "REVIEW"


def merge_duplicates(rows: DataFrame, keys: list[str], fields: list[str], base: list[str], order: list[str], marker: str = REVIEW) -> DataFrame:
    """One row per key.  A field keeps its one value, as the first row in ``order`` writes it, else reads ``marker`` and is a conflict.

    Blank values are no values, and white space makes no difference.  base: columns taken from the first row.
    Distinct values are gathered as sets before the shuffle, so a hot key costs its values and not its rows."""
    first = F.min_by(F.struct(*base), F.struct(*order)).alias("_base")
    filled = {f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "" for f in fields}
    sets = [F.collect_set(F.when(ok, T.norm(F.col(f)))).alias(f"_{f}") for f, ok in filled.items()]
    firsts = [F.min_by(F.when(ok, F.trim(F.col(f).cast("string"))), F.when(ok, F.struct(*order))).alias(f"_first_{f}") for f, ok in filled.items()]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), first, *sets, *firsts)
    values = [F.when(F.size(f"_{f}") > 1, F.lit(marker)).otherwise(F.coalesce(f"_first_{f}", F.lit(""))).alias(f) for f in fields]
    conflict = F.lit(False)
    for f in fields:
        conflict = conflict | (F.size(f"_{f}") > 1)
    return out.select(*keys, "n_rows", *[F.col(f"_base.{b}").alias(b) for b in base], *values, conflict.alias("conflict"))


def disjoint_groups(rows: DataFrame, weak: list[str], location: str, page: str) -> DataFrame:
    """Weak-key groups of several rows and locations, and whether no page occurs twice."""
    counted = rows.groupBy(*weak).agg(F.count("*").alias("n_rows"), F.size(F.collect_set(location)).cast("long").alias("n_locations"), F.size(F.collect_set(page)).cast("long").alias("n_pages"))
    return counted.where("n_rows > 1 and n_locations > 1").withColumn("disjoint", F.col("n_rows") == F.col("n_pages"))


def score(signals: dict[str, tuple[Column, int]]) -> tuple[Column, Column]:
    """(sum of the weights whose signal holds, their names)."""
    total, why = F.lit(0), []
    for name, (holds, weight) in signals.items():
        total = total + F.when(holds, weight).otherwise(0)
        why.append(F.when(holds, F.lit(name)))
    return total, F.array_compact(F.array(*why))


def link(left: DataFrame, right: DataFrame, on: Column, signals: dict[str, tuple[Column, int]], conflict: Column, best: int, sure: float = 0.9, maybe: float = 0.7) -> DataFrame:
    """Pairs that meet ``on`` with score, reasons, confidence, conflict and status; score 0 is dropped.

    The left rows are dealt to all tasks first: pairs are many more than rows, and a small file is read by one task."""
    total, why = score(signals)
    left = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *left.columns)
    pairs = left.join(right, on).withColumns({"score": F.least(total, F.lit(best)), "reasons": why, "conflict": F.coalesce(conflict, F.lit(False))})
    pairs = pairs.where("score > 0").withColumn("confidence", F.col("score") / F.lit(float(best)))
    status = F.when((F.col("confidence") >= sure) & ~F.col("conflict"), "confirmed").when((F.col("confidence") >= maybe) | F.col("conflict"), "review").otherwise("unmatched")
    return pairs.withColumn("status", status)


def top_k(pairs: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_linked(left: DataFrame, right: DataFrame, on: Column, signals: dict[str, tuple[Column, int]], conflict: Column, best: int, by: list[str], order: list[Column], k: int, steps: list[list[tuple[str, ...]]]) -> DataFrame:
    """``top_k`` of ``link`` by falling score, then ``order``, without looking at every pair.

    A step is a list of sets of signals that are equalities: only pairs in which all signals of one of its sets hold are
    looked at.  Any other pair lacks a signal of each set, which bounds its score; a left row (``by``) with k pairs above
    that bound has its k best, and only the others go into the next step, in the end over all pairs.  Weights are not
    negative."""
    ranking, kept, rest = [F.desc("score"), *order], [], left
    for sets in steps:
        found, seen = [], F.lit(False)
        for names in sets:
            holds = reduce(and_, [signals[n][0] for n in names])
            found.append(link(rest, right, on & holds & ~seen, signals, conflict, best))
            seen = seen | F.coalesce(holds, F.lit(False))
        least = min(sum(signals[n][1] for n in set(lacking)) for lacking in product(*sets))
        bound = min(best, sum(w for _, w in signals.values()) - least)
        ranked = top_k(reduce(DataFrame.unionByName, found).where(F.col("score") > bound), by, ranking, k)
        sure = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") == k).drop("_n")
        kept.append(sure)
        done = sure.where(F.col("rank") == k).select(*[F.col(c).alias(f"_{c}") for c in by])
        rest = rest.join(done, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left_anti")
    return reduce(DataFrame.unionByName, [*kept, top_k(link(rest, right, on, signals, conflict, best), by, ranking, k)])


def near_and_far(left: DataFrame, right: DataFrame, keys: list[str], value: str, reach: float) -> DataFrame:
    """Left rows with ``near`` and ``far``: whether a right row of equal ``keys`` has a ``value`` within ``reach``, and one beyond it.

    Either side has the keys and the value; rows without one of them meet nothing.  No pair is built: what lies beyond is
    told by the least and greatest value of the keys, what lies within by those of the value's own and the two blocks of
    ``reach`` on either side, a few values for each key and block."""
    given = right.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, value)]))
    ends = given.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    blocks = given.groupBy(*keys, F.rint(F.col(value) / reach).alias("_b")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    seen = blocks.select(*keys, F.explode(F.array(*[F.col("_b") + i for i in range(-2, 3)])).alias("_b"), "_lo", "_hi")
    seen = seen.groupBy(*keys, "_b").agg(F.array_union(F.collect_set("_lo"), F.collect_set("_hi")).alias("_near"))
    out = left.withColumn("_b", F.rint(F.col(value) / reach)).join(seen, [*keys, "_b"], "left").join(ends, keys, "left")
    within = lambda x: F.abs(F.col(value) - x) <= reach
    far = ~within(F.col("_lo")) | ~within(F.col("_hi"))
    return out.withColumns({"near": F.coalesce(F.exists("_near", within), F.lit(False)), "far": F.coalesce(far, F.lit(False))}).drop("_b", "_near", "_lo", "_hi")


def one_to_one(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy 1:1 match on equal keys: the n-th of either side with the n-th of the other; side is matched, missed or extra.

    Equal keys are interchangeable, so only how many each side has counts: both sides are
    counted before the shuffle and no key's rows meet in one task."""
    a = truth.groupBy(*keys).agg(F.count("*").alias("n_truth"))
    b = found.groupBy(*keys).agg(F.count("*").alias("n_found"))
    both = a.join(b, keys, "full_outer").fillna(0, ["n_truth", "n_found"])
    matched = F.least("n_truth", "n_found")
    return both.select(*keys, matched.alias("matched"), (F.col("n_truth") - matched).alias("missed"), (F.col("n_found") - matched).alias("extra"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn."""
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def unmatched(rows: DataFrame, evidence: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows that no evidence table meets on its key: chained anti joins, null keys never meet."""
    for other, own_key, key in evidence:
        keys = other.select(F.col(key).alias("_key")).where("_key is not null").distinct()
        rows = rows.join(keys, rows[own_key] == F.col("_key"), "left_anti")
    return rows


def overlap_pairs(items: DataFrame, owner: str, item: str, least: float = 0.8) -> DataFrame:
    """Pairs of owners whose distinct items overlap by at least ``least`` of the smaller set.

    Owners with the same items are one class: pairs run between the classes' smallest
    owners, and each other member is paired with its own class's smallest owner alone, so a
    group of copies costs its size.  Prefix filter: items are ordered by rarity; a pair that
    reaches the overlap shares one of the first size - ceil(least * size) + 1 items of the
    smaller owner."""
    every = items.select(F.col(owner).alias("o"), F.col(item).alias("i")).where("i is not null").distinct()
    digest = every.groupBy("o").agg(F.count("*").alias("size"), F.md5(F.array_join(F.sort_array(F.collect_list(F.md5(F.col("i").cast("binary")))), "").cast("binary")).alias("d"))
    classes = digest.groupBy("d", "size").agg(F.min("o").alias("rep"))
    member = digest.join(classes, ["d", "size"]).where("o <> rep").select(F.col("rep").alias("a"), F.col("o").alias("b"), "size", F.col("size").alias("shared"))
    own = every.join(classes.select(F.col("rep").alias("o")), "o", "left_semi")
    counted = own.groupBy("i").agg(F.count("*").alias("df"))
    ranked = own.join(counted, "i").join(classes.select(F.col("rep").alias("o"), "size"), "o")
    place = Window.partitionBy("o").orderBy("df", "i")
    # ranks run over all items of an owner; items of one owner alone take their place and meet nothing
    prefix = ranked.withColumn("at", F.row_number().over(place)).where(F.col("at") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1).where("df > 1")
    a = prefix.select(F.col("o").alias("p"), "i", F.col("size").alias("p_size"))
    b = ranked.where("df > 1").select(F.col("o").alias("q"), "i", F.col("size").alias("q_size"))
    near = a.join(b, "i").where((F.col("p") != F.col("q")) & (F.col("p_size") <= F.col("q_size")))
    near = near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.least("p_size", "q_size").alias("size")).distinct()
    shared = near.join(own.select(F.col("o").alias("a"), "i"), "a").join(own.select(F.col("o").alias("b"), "i"), ["b", "i"]).groupBy("a", "b", "size").agg(F.count("*").alias("shared"))
    pairs = shared.withColumn("overlap", F.col("shared") / F.col("size")).where(F.col("overlap") >= least)
    return pairs.unionByName(member.withColumn("overlap", F.lit(1.0)))


def hamming_pairs(hashes: DataFrame, key: str, value: str, most: int = 8) -> DataFrame:
    """Pairs (a, b, distance) of 64-bit hashes that differ in at most ``most`` bits.

    Equal hashes are one class: pairs run between the classes' smallest keys, each other
    member meets its own class's smallest key alone at distance 0.  Of ``most + 2`` bands at
    least two agree in every pair, so hashes meet on a pair of bands and not all with all."""
    rows = hashes.select(F.col(key).alias("k"), F.col(value).alias("h")).where("h is not null")
    classes = rows.groupBy("h").agg(F.min("k").alias("rep"))
    member = rows.join(classes, "h").where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(0).alias("distance"))
    n = most + 2
    edges = [64 * i // n for i in range(n + 1)]
    band = [F.shiftrightunsigned("h", edges[i]).bitwiseAND((1 << edges[i + 1] - edges[i]) - 1) for i in range(n)]
    keys = [F.struct(F.lit(i * n + j).alias("n"), band[i].alias("x"), band[j].alias("y")) for i in range(n) for j in range(i + 1, n)]
    met = classes.select("rep", "h", F.explode(F.array(*keys)).alias("at"))
    other = met.select(F.col("rep").alias("rep2"), F.col("h").alias("h2"), "at")
    distance = F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))).cast("int")
    near = met.join(other, "at").where((F.col("rep") < F.col("rep2")) & (distance <= most))
    return near.select(F.col("rep").alias("a"), F.col("rep2").alias("b"), distance.alias("distance")).distinct().unionByName(member)


def bits_at_least_mean(values: Column, n: int = 64) -> Column:
    """Average hash: bit k is set where value k is at least the mean of all n."""
    mean = F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x) / n
    return F.aggregate(F.transform(values, lambda x: x >= mean), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
