"""Mixing sources to target weights by hierarchical budgeting.

Plan. Documents are counted once in tokens of a public tokenizer. Supplies are added up by leaf
(domain, language, source); only these sums reach the driver. A mix's weights go down the tree, a
source's weight in proportion to what its leaves hold, so that all leaves of a source run short
together or not at all. A node that can't use its budget, even with all repeats, gives the rest to its
siblings, and only what they can't take goes to its ancestors' siblings. Each leaf then takes whole
seeded epochs and a prefix of one more. A prefix is found by sums over hash ranges, so the documents
of a leaf never meet in one task, however large it is. As documents are whole, a leaf ends before or
after the document that crosses its budget; which is chosen from leaf to leaf so that what a source
has missed so far stays within half a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewright.llm.tokens import VOCABULARY, with_tokens
from quirewright.plans.storage import materialise


@dataclass(frozen=True)
class MixParams:
    """budget: tokens of the mix, as a factor of its sources' supply, or None for the most that meets every target; rows_per_range: documents per hash range."""

    budget: float | None = 1.0
    rows_per_range: int = 20_000
    seed: int = 17
    vocabulary: str = VOCABULARY


def share_out(total: float, weights: list[float], room: list[float]) -> list[float]:
    """``total`` by weight, none above its room; what some can't take goes to the others by weight."""
    got = [0.0] * len(weights)
    open_ = [i for i in range(len(weights)) if weights[i] > 0 and room[i] > 0]
    left = min(total, sum(room[i] for i in open_))
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] - got[i] <= left * weights[i] / w + 1e-9]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / w
            break
        for i in full:
            left -= room[i] - got[i]
            got[i] = room[i]
        open_ = [i for i in open_ if i not in full]
    return got


def allot(leaves: dict[tuple, tuple[float, float]], total: float, depth: int = 0) -> dict[tuple, float]:
    """The budget of each leaf. leaves: path -> (weight, room); siblings share the path up to ``depth``."""
    if len(leaves) == 1 and depth >= len(next(iter(leaves))):
        (path, (_, room)), *_ = leaves.items()
        return {path: min(total, room)}
    groups: dict = {}
    for path, v in leaves.items():
        groups.setdefault(path[depth], {})[path] = v
    names = sorted(groups, key=str)
    parts = share_out(total, [sum(w for w, _ in groups[n].values()) for n in names], [sum(r for _, r in groups[n].values()) for n in names])
    out: dict = {}
    for n, t in zip(names, parts):
        out |= allot(groups[n], t, depth + 1)
    return out


_LEAF = ["domain", "lang", "source"]


def mix(docs: DataFrame, targets: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(mix_name, doc_id, epoch, domain, source, lang, tokens, target_share): the chosen documents, once per epoch.

    docs: (doc_id, text, source, lang, domain); targets: (mix_name, source, target_share, max_repeats).
    Documents without text, id or source take no part; a null language is 'und', case is ignored, a
    null domain is ''. Shares are scaled to a sum of 1 per mix; null or non-positive shares are left
    out, null repeats are 1; of repeated targets for one source the shares are added and the smallest
    repeats count. Sources without documents count only where a budget is given: the others take their
    part. A budget beyond all repeats is cut to these. Empty tables give no rows.
    """
    spark = docs.sparkSession
    wanted = targets.where((F.col("target_share") > 0) & F.col("source").isNotNull()).groupBy("mix_name", "source")
    wanted = wanted.agg(F.sum("target_share").alias("share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats")).collect()
    schema = "mix_name string, doc_id long, epoch int, domain string, source string, lang string, tokens long, target_share double"
    names = sorted({r["source"] for r in wanted})
    if not names:
        return spark.createDataFrame([], schema)
    rows = docs.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull() & F.col("source").isin(names))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("domain", F.lit("")).alias("domain"), "source", F.lower(F.coalesce("lang", F.lit("und"))).alias("lang"), "text")
    counted = materialise(with_tokens(rows, ["doc_id", *_LEAF], params.vocabulary), "token-counts")
    supply = {tuple(r[c] for c in _LEAF): (r["tokens"], r["n"]) for r in counted.groupBy(*_LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    of_source: dict[str, int] = {}
    for (_, _, s), (t, _) in supply.items():
        of_source[s] = of_source.get(s, 0) + t

    budgets: dict[tuple, float] = {}
    share_of: dict[tuple, float] = {}
    for name in sorted({r["mix_name"] for r in wanted}):
        own = {r["source"]: (r["share"], r["repeats"]) for r in wanted if r["mix_name"] == name}
        whole = sum(s for s, _ in own.values())
        stocked = {s: v for s, v in own.items() if of_source.get(s) and v[1]}
        if not stocked:
            continue
        if params.budget is None:
            some = sum(s for s, _ in stocked.values())
            total = min(of_source[s] * k / (w / some) for s, (w, k) in stocked.items())
        else:
            total = params.budget * sum(of_source[s] for s in stocked)
        leaves = {p: (stocked[p[2]][0] / whole * t / of_source[p[2]], float(t * stocked[p[2]][1])) for p, (t, _) in supply.items() if p[2] in stocked and t}
        budgets |= {(name, *path): got for path, got in allot(leaves, total).items()}
        share_of |= {(name, s): w / whole for s, (w, _) in stocked.items()}
    if not budgets:
        return spark.createDataFrame([], schema)

    plan = {}
    for key, got in budgets.items():
        t, n = supply[key[1:]]
        epochs = int((got + 1e-6) // t)
        plan[key] = (epochs, int(round(got - epochs * t)), max(1, n // params.rows_per_range), share_of[key[0], key[3]])
    crossing = _matched(counted, plan).transform(_placed, params).where("total > rest").groupBy("mix_name", *_LEAF).agg(F.min(F.struct("total", "tokens")).alias("at")).collect()  # a row per mix and leaf at most
    at = {(r["mix_name"], *(r[c] for c in _LEAF)): (r["at"]["total"], r["at"]["tokens"]) for r in crossing}
    missed: dict[tuple, float] = {}
    for key in sorted(plan):
        if key in at:
            of, (total, tokens), (epochs, rest, ranges, share) = (key[0], key[3]), at[key], plan[key]
            so_far = missed.get(of, 0.0)
            end = min((total - tokens, total), key=lambda e: abs(so_far + e - rest))
            missed[of] = so_far + end - rest
            plan[key] = (epochs, end, ranges, share)
    return _take(_matched(counted, plan), params)


_TAKEN = ["mix_name", "doc_id", "epoch", "domain", "source", "lang", "tokens", "target_share"]


def _matched(counted: DataFrame, plan: dict) -> DataFrame:
    """The documents with what their leaf gives to each mix: whole epochs and the tokens of one more."""
    rows = [(*key, *v) for key, v in plan.items()]
    table = counted.sparkSession.createDataFrame(rows, "mix_name string, domain string, lang string, source string, epochs int, rest long, ranges long, target_share double")
    return counted.join(F.broadcast(table), _LEAF)  # a row per mix and leaf


def _placed(matched: DataFrame, params: MixParams) -> DataFrame:
    """The documents of the hash ranges up to the one in which a leaf's budget ends, with ``total``, the leaf's tokens up to and with each of them; 0 where the whole range belongs to it."""
    key = ["mix_name", *_LEAF]
    order = F.xxhash64(F.lit(params.seed), "mix_name", "epochs", "doc_id")
    part = matched.where(F.col("rest") > 0).withColumn("h", order).withColumn("range", F.pmod("h", F.col("ranges")))
    sums = part.groupBy(*key, "range", "rest").agg(F.sum("tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).where(F.col("before") < F.col("rest")).select(*key, "range", "before", (F.col("before") + F.col("held") > F.col("rest")).alias("edge"))
    placed = part.join(sums, [*key, "range"])
    running = F.sum("tokens").over(Window.partitionBy(*key, "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where("edge").withColumn("total", F.col("before") + running)
    return placed.where(~F.col("edge")).withColumn("total", F.lit(0).cast("long")).unionByName(edge)


def _take(matched: DataFrame, params: MixParams) -> DataFrame:
    """The chosen documents."""
    full = matched.where(F.col("epochs") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).select(*_TAKEN)
    last = _placed(matched, params).where(F.col("total") <= F.col("rest")).withColumn("epoch", F.col("epochs"))
    return full.unionByName(last.select(*_TAKEN))


def shares(chosen: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, documents, tokens, share, epochs): what each source reached."""
    by = chosen.groupBy("mix_name", "source", "target_share").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), (F.max("epoch") + 1).alias("epochs"))
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))  # one row per source
    return by.withColumn("share", F.round(F.col("tokens") / total, 6))
