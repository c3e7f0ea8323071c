"""Evaluation on span tables: exact and partial matches, leaks, over-masking, thresholds, confidence and variance.

Gold and predicted spans are rows (doc_id, tag, start_pos, end_pos); gold brings its text in value. The spans of a document
are judged together, in one pass over them; everything else is counted over the verdicts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import ACTIONS, STAGES, severity
from .recognise import lists_array
from .spans import lookup
from .suspicion import united

SPAN_KEYS = ["doc_id", "tag", "start_pos", "end_pos"]
LEVELS = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)
#: Gold spans that a tag needs for its thresholds to be judged, and the range of over-masking below which they tell nothing.
LEAST_GOLD, LEAST_RANGE = 5, 3
VERDICT = "array<struct<side:string,tag:string,start_pos:int,end_pos:int,value:string,verdict:string,significant:int,open_chars:int,open_value:string,weight:double,leak_weight:double>>"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()]


def weight(tag: Column) -> Column:
    return lookup({t: severity(t) for t in STAGES}, tag, severity(""))


def verdicts(gold: list[tuple[str, int, int, str]], pred: list[tuple[str, int, int]], actions: dict[str, str], excluded: frozenset[str] = frozenset()) -> list[tuple]:
    """Rows of VERDICT for the spans of one document.

    Gold is exact, partial or missed: it takes the first prediction of its tag at its place, else the first that overlaps
    it, and each prediction is taken once. What leaks is counted by signs, whatever the tag: signs of gold that is to be
    masked, white space aside, that no prediction to be masked covers. Predictions that nothing took are over, unless their
    tag is excluded.
    """
    gold, pred = sorted(gold, key=lambda g: (g[1], g[2], g[0])), sorted(pred, key=lambda p: (p[1], p[2], p[0]))
    masks = lambda tag: tag not in excluded and actions.get(tag) == "mask"
    starts, ends = united([(a, b) for t, a, b in pred if masks(t)])
    own: dict[str, list[int]] = defaultdict(list)
    same: dict[tuple, list[int]] = defaultdict(list)
    for i, p in enumerate(pred):
        own[p[0]].append(i)
        same[p].append(i)
    reach = {tag: _reach([pred[i] for i in at]) for tag, at in own.items()}
    used: set[int] = set()
    out = []
    for tag, a, b, value in gold:
        verdict = "missed"
        at = next((i for i in same.get((tag, a, b), ()) if i not in used), None)
        if at is not None:
            verdict = "exact"
        elif tag in own:
            begins, ahead = reach[tag]
            k = bisect_right(ahead, a)  # before it, nothing of the tag reaches behind the start
            while k < len(begins) and begins[k] < b:
                i = own[tag][k]
                if i not in used and pred[i][2] > a:
                    at, verdict = i, "partial"
                    break
                k += 1
        if at is not None:
            used.add(at)
        significant = open_chars = 0
        rest = ""
        if masks(tag):
            k = max(0, bisect_left(ends, a + 1))
            left = []
            for j, c in enumerate(value or "", a):
                if c.isspace():
                    continue
                significant += 1
                while k < len(ends) and ends[k] <= j:
                    k += 1
                if k == len(ends) or starts[k] > j:
                    left.append(c)
            open_chars, rest = len(left), "".join(left)
        w = severity(tag) if masks(tag) else 0.0
        out.append(("gold", tag, a, b, value, verdict, significant, open_chars, rest, w, w * open_chars / max(1, significant)))
    for i, (tag, a, b) in enumerate(pred):
        verdict = "used" if i in used else "plain" if tag in excluded else "over"
        out.append(("pred", tag, a, b, None, verdict, 0, 0, None, 0.0, 0.0))
    return out


def _reach(places: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts in order, and the furthest end up to each."""
    ahead, top = [], 0
    for _, _, b in places:
        top = max(top, b)
        ahead.append(top)
    return [a for _, a, _ in places], ahead


def judged(gold: DataFrame, pred: DataFrame, excluded: tuple[str, ...] = (), actions: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, side, tag, start_pos, end_pos, value, verdict, significant, open_chars, open_value, weight, leak_weight):
    a row for each gold and each predicted span. Spans with nulls are left out; repeated spans count as often as they
    come."""
    whole = F.col("tag").isNotNull() & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull() & F.col("doc_id").isNotNull()
    g = gold.where(whole).groupBy("doc_id").agg(F.collect_list(F.struct("tag", F.col("start_pos").cast("int").alias("a"), F.col("end_pos").cast("int").alias("b"), "value")).alias("g"))
    p = pred.where(whole).groupBy("doc_id").agg(F.collect_list(F.struct("tag", F.col("start_pos").cast("int").alias("a"), F.col("end_pos").cast("int").alias("b"))).alias("p"))
    acts, out = actions or ACTIONS, frozenset(excluded)

    @F.arrow_udf(VERDICT)
    def done(gs: pa.Array, ps: pa.Array) -> pa.Array:
        rows = [verdicts([tuple(x.values()) for x in a or ()], [tuple(x.values()) for x in b or ()], acts, out) for a, b in zip(gs.to_pylist(), ps.to_pylist())]
        return lists_array(rows, ["side", "tag", "start_pos", "end_pos", "value", "verdict", "significant", "open_chars", "open_value", "weight", "leak_weight"], _KINDS)

    return g.join(p, "doc_id", "full").select("doc_id", F.explode(done("g", "p")).alias("v")).select("doc_id", "v.*")


def exact(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Matched pairs of equal document, tag and place, each span used once: copies are numbered on both sides."""
    w = Window.partitionBy(*SPAN_KEYS).orderBy(F.lit(1))
    number = lambda df: df.select(*SPAN_KEYS).withColumn("copy", F.row_number().over(w))
    return number(gold).join(number(pred), [*SPAN_KEYS, "copy"])


def leaks(gold: DataFrame, pred: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(gold keys, significant, open_chars, weight, leak_weight): signs of each gold span that nothing masks."""
    return judged(gold, pred, excluded).where("side = 'gold'").select(*SPAN_KEYS, "significant", "open_chars", "weight", "leak_weight")


def overlapping(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold spans that a predicted span of the same tag meets in part or whole, with the number of such spans."""
    p = pred.select("doc_id", "tag", F.col("start_pos").alias("p_start"), F.col("end_pos").alias("p_end"))
    met = gold.select(*SPAN_KEYS).distinct().join(p, ["doc_id", "tag"]).where((F.col("start_pos") < F.col("p_end")) & (F.col("p_start") < F.col("end_pos")))
    return met.groupBy(*SPAN_KEYS).agg(F.count("*").alias("meeting"))


def over(gold: DataFrame, pred: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Predicted spans that no gold span took as its match, tags that stay readable on purpose aside."""
    return judged(gold, pred, excluded).where("verdict = 'over'").select(*SPAN_KEYS)


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from gold, pred and exact; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = counts.withColumn("precision", ratio("exact", "pred")).withColumn("recall", ratio("exact", "gold"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def _counters() -> list[Column]:
    of = lambda name: F.count_if(F.col("verdict") == name)
    gold = F.col("side") == "gold"
    return [F.count_if(gold).alias("gold"), F.count_if(~gold).alias("pred"), of("exact").alias("exact"), of("partial").alias("partial"), of("missed").alias("missed"), F.count_if(F.col("open_chars") > 0).alias("leaked"), F.sum("leak_weight").alias("leak_weight")]


def per_tag(gold: DataFrame, pred: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(tag, gold, pred, exact, partial, missed, leaked, leak_weight, precision, recall, f1)."""
    return scores(judged(gold, pred, excluded).groupBy("tag").agg(*_counters()))


def totals(gold: DataFrame, pred: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """One row: gold, pred, exact, partial, missed, leaked, leak_weight, total_weight, over, plain, leak_rate, micro_f1."""
    rows = judged(gold, pred, excluded)
    plain = F.count_if((F.col("side") == "gold") & F.col("tag").isin(*excluded)) if excluded else F.lit(0).cast("bigint")
    out = rows.agg(*_counters(), F.sum("weight").alias("total_weight"), F.count_if(F.col("verdict") == "over").alias("over"), plain.alias("plain"))
    out = scores(out.na.fill(0)).withColumnRenamed("f1", "micro_f1").drop("precision", "recall")
    return out.withColumn("leak_rate", F.coalesce(F.try_divide(F.col("leak_weight"), F.col("total_weight")), F.lit(0.0)))


def report(gold: DataFrame, pred: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """per_tag in the order of a report: most leaked first, then most missed, then by name."""
    return per_tag(gold, pred, excluded).orderBy(F.desc("leaked"), F.desc("missed"), "tag")


def worst_leaks(gold: DataFrame, pred: DataFrame, most: int = 8, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The heaviest leaks, as the top of a report: (doc_id, tag, start_pos, value, open_value, leak_weight)."""
    rows = judged(gold, pred, excluded).where("open_chars > 0")
    return rows.select("doc_id", "tag", "start_pos", "value", "open_value", "leak_weight").orderBy(F.desc("leak_weight"), "doc_id", "start_pos", "tag").limit(most)


def grouped(spans: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """One report for each level and one for all, by grouping sets in one pass; grp names the level."""
    named = F.concat_ws("+", *[F.when(F.grouping(c) == 0, c) for c in levels])
    sets = [[F.col(c)] for c in levels] + [[]]
    out = spans.groupingSets(sets, *levels).agg(named.alias("grp"), *[m.alias(n) for n, m in measures.items()])
    return out.withColumn("grp", F.when(F.col("grp") == "", "all").otherwise(F.col("grp")))


def sweep(scored: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(tag, level, leaks, over) of each threshold: scored has (tag, score, is_gold). The rows are scanned once; each
    is counted at every level by a sum of conditions, so nothing is multiplied."""
    sums = [c for i, x in enumerate(levels) for c in (F.count_if(F.col("is_gold") & (F.col("score") < x)).alias(f"l{i}"), F.count_if(~F.col("is_gold") & (F.col("score") >= x)).alias(f"o{i}"))]
    wide = scored.groupBy("tag").agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"l{i}").alias("leaks"), F.col(f"o{i}").alias("over")) for i, x in enumerate(levels)]))
    return wide.select("tag", rows.alias("r")).select("tag", "r.*")


def best_level(swept: DataFrame, now: dict[str, float] | None = None) -> DataFrame:
    """(tag, best, leaks, over, flat, tips, better): fewest leaks, then fewest over, then the lower level; flat where
    over-masking hardly moves over all levels. With the present thresholds, tips is the first level with more leaks than
    now, and better tells whether the best level beats the present one; both are null without."""
    here = lookup(now or {}, F.col("tag"), None).cast("double")
    at_now = F.min(F.when(F.abs(F.col("level") - here) < 1e-9, F.struct("leaks", "over")))
    best = swept.groupBy("tag").agg(F.min(F.struct("leaks", "over", "level")).alias("b"), (F.max("over") - F.min("over") < LEAST_RANGE).alias("flat"), at_now.alias("n"), F.sort_array(F.collect_list(F.struct("level", "leaks"))).alias("curve"))
    tips = F.get(F.filter("curve", lambda c: c["leaks"] > F.col("n.leaks")), F.lit(0))["level"]
    better = F.when(F.col("n").isNotNull(), ~F.col("flat") & (F.struct("b.leaks", "b.over") < F.col("n")))
    return best.select("tag", F.col("b.level").alias("best"), "b.leaks", "b.over", "flat", tips.alias("tips"), better.alias("better"))


def enough_gold(scored: DataFrame, least: int = LEAST_GOLD) -> DataFrame:
    """The scored spans of tags with enough gold to be judged; tags are few, so their list is broadcast."""
    tags = scored.groupBy("tag").agg(F.count_if("is_gold").alias("_n")).where(F.col("_n") >= least).select("tag")
    return scored.join(F.broadcast(tags), "tag", "left_semi")


def confidence(scored: DataFrame) -> DataFrame:
    """(tag, least, upper_median, n): the upper of the two middle scores where their number is even. Equal scores are
    counted before they are lined up, so a common tag costs as many rows as it has different scores."""
    counts = scored.groupBy("tag", "score").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tag").orderBy("score")
    lined = counts.withColumn("_upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(Window.partitionBy("tag")))
    return lined.groupBy("tag").agg(F.min("score").alias("least"), F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("score"))).alias("upper_median"), F.sum("n").alias("n"))


def variance(runs: DataFrame, condition: str, value: str) -> DataFrame:
    """(condition, n, mean, sd, note): sample deviation; one run has none, below three no multiples are given."""
    out = runs.groupBy(condition).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("note", F.when(F.col("n") < 2, "none").when(F.col("n") < 3, "few").otherwise("ok"))


def differences(runs: DataFrame, condition: str, value: str) -> DataFrame:
    """(a, b, delta, sd, times, verdict, few) of two conditions, a before b: the difference of the means against the larger
    deviation. clear above twice it, weak above once, else unresolved; "no deviation" where it is 0 or null. Other numbers
    of conditions give no row."""
    row = F.struct("mean", "sd", "n")
    c = F.col(condition)
    pair = variance(runs, condition, value).agg(F.count("*").alias("k"), F.min(c).alias("a"), F.max(c).alias("b"), F.min_by(row, c).alias("x"), F.max_by(row, c).alias("y")).where("k = 2")
    met = pair.select("a", "b", (F.col("y.mean") - F.col("x.mean")).alias("delta"), F.greatest("x.sd", "y.sd").alias("sd"), (F.least("x.n", "y.n") < 3).alias("few"))
    met = met.withColumn("times", F.when(F.col("sd") > 0, F.abs("delta") / F.col("sd")))
    verdict = F.when(F.col("times").isNull(), "no deviation").when(F.col("times") > 2, "clear").when(F.col("times") > 1, "weak").otherwise("unresolved")
    return met.select("a", "b", "delta", "sd", "times", verdict.alias("verdict"), "few")


#: Conditions that single runs may be held against.
MOST_CONDITIONS = 1_000


def against(single: DataFrame, runs: DataFrame, condition: str, value: str) -> DataFrame:
    """(run, condition, z) of single runs (run, value) against each condition with three runs or more; null where those
    don't vary. Conditions are the few settings that runs are made under; more than MOST_CONDITIONS raise."""
    known = variance(runs, condition, value).where("n >= 3").orderBy(condition).limit(MOST_CONDITIONS + 1).collect()
    if len(known) > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions")
    kind = "array<struct<c:string,mean:double,sd:double>>"
    own = F.array(*[F.struct(F.lit(str(r[condition])).alias("c"), F.lit(r["mean"]).alias("mean"), F.lit(r["sd"]).alias("sd")) for r in known]).cast(kind)
    rows = single.withColumn("_k", F.explode(own))
    return rows.select("run", F.col("_k.c").alias(condition), F.when(F.col("_k.sd") > 0, (F.col(value) - F.col("_k.mean")) / F.col("_k.sd")).alias("z"))


def containment(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(wanted keys, verdict, instead): "right" if a find of the tag covers the whole place, "label" if any find touches it,
    else "leak"; instead names the tags that touch it where the label is wrong."""
    f = found.select("doc_id", F.col("tag").alias("f_tag"), F.col("start_pos").alias("f_start"), F.col("end_pos").alias("f_end"))
    touch = F.col("doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f_start") < F.col("end_pos")) & (F.col("start_pos") < F.col("f_end"))
    met = wanted.select(*SPAN_KEYS).distinct().join(f, "doc_id", "left")
    right = touch & (F.col("f_tag") == F.col("tag")) & (F.col("f_start") <= F.col("start_pos")) & (F.col("f_end") >= F.col("end_pos"))
    out = met.groupBy(*SPAN_KEYS).agg(F.coalesce(F.bool_or(right), F.lit(False)).alias("r"), F.coalesce(F.bool_or(touch), F.lit(False)).alias("t"), F.sort_array(F.collect_set(F.when(touch, F.col("f_tag")))).alias("instead"))
    verdict = F.when(F.col("r"), "right").when(F.col("t"), "label").otherwise("leak")
    return out.select(*SPAN_KEYS, verdict.alias("verdict"), F.when(verdict == "label", F.array_join("instead", ", ")).alias("instead"))


def verdict_table(judged_: DataFrame, block: str) -> DataFrame:
    """(block, tag, right, label, leak) from containment() with a column that names a block of probes."""
    return judged_.groupBy(block, "tag").pivot("verdict", ["right", "label", "leak"]).count().na.fill(0)


def cases(gold_docs: DataFrame, found: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(gold, predictions) as span tables, from gold documents (key, text, spans as array<struct<tag, start, end>>) and finds
    (key, spans); documents without text have none, and finds of other documents are left out."""
    own = gold_docs.where("text is not null")
    flat = lambda df: df.select(F.col(key).alias("doc_id"), *(["text"] if "text" in df.columns else []), F.explode("spans").alias("s"))
    gold = flat(own).select("doc_id", "s.tag", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))
    pred = flat(found.join(own.select(key), key, "left_semi").drop("text")).select("doc_id", "s.tag", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))
    return gold, pred


def unreported(expected: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """What was expected and is missing from a report."""
    return expected.select(key).distinct().join(reported.select(key), key, "left_anti")


def lookup_confidence(found: DataFrame, scored: DataFrame) -> DataFrame:
    """(span keys, confidence) of model spans: the score at the same place, else the least of those of the tag that
    overlap; touching is no overlap."""
    same = scored.groupBy(*SPAN_KEYS).agg(F.min("score").alias("same_score"))
    p = scored.select("doc_id", "tag", F.col("start_pos").alias("p_start"), F.col("end_pos").alias("p_end"), "score")
    near = found.select(*SPAN_KEYS).distinct().join(p, ["doc_id", "tag"]).where((F.col("start_pos") < F.col("p_end")) & (F.col("p_start") < F.col("end_pos"))).groupBy(*SPAN_KEYS).agg(F.min("score").alias("near_score"))
    return found.join(same, SPAN_KEYS, "left").join(near, SPAN_KEYS, "left").select(*SPAN_KEYS, F.coalesce("same_score", "near_score").alias("confidence"))
