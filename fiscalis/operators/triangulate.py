"""Linking projects of one oversight report to findings of another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from fiscalis.operators.lineage import cut, joined
from fiscalis.operators.mart import absorption, verdict

LEAST = 65.0
#: Characters of a project's name that are looked for in a sentence.
HEAD = 60
#: Pairs of names of one county that a task looks at, about.
PAIRS = 1_000_000
#: Risks that make a match severe.
SEVERE = ("FLAGGED_BY_MODEL", "INCOMPLETE_PROJECT", "UNSUPPORTED_PAYMENT", "PROCUREMENT_BREACH", "DUPLICATE_PAYMENT")


def _places(a: str) -> dict[str, int]:
    """For each character the places at which it stands, as bits."""
    out: dict[str, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _common(places: dict[str, int], size: int, b: str) -> int:
    """The length of the longest common subsequence, all places of the first text at a time as the bits of a whole number."""
    full = (1 << size) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def likeness(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    return 200.0 * _common(_places(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def sorted_likeness(a: str, b: str) -> float:
    return likeness(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def part_likeness(a: str, b: str) -> float:
    """The best likeness of the shorter to any stretch of the longer that is as long, those cut off by the edges included."""
    short, long_ = sorted((a, b), key=len)
    m = len(short)
    if not m:
        return 100.0 if not long_ else 0.0
    places = _places(short)
    stretches = {long_[max(0, i) : i + m] for i in range(1 - m, len(long_))}
    return max(200.0 * _common(places, m, x) / (m + len(x)) for x in stretches)


def score(project: str, finding: str, sentence: str) -> float:
    """Of names if the finding has one, else of the project's first 60 characters and the sentence; case doesn't matter."""
    project, finding, sentence = project.lower(), finding.lower(), sentence.lower()
    return max(sorted_likeness(project, finding), part_likeness(project, finding)) if finding else part_likeness(project[:HEAD], sentence)


#: Kinds of characters that are counted (by the last bits of their code), bits for the count of each, characters of the shorter text that fit into one number, and stretches that are looked at at once.
KINDS, EACH, WORD, AT_ONCE = 32, 6, 64, 1_000_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """All characters of the texts as small numbers, where each text begins, and how many numbers there are."""
    values, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    return codes, np.cumsum([0, *map(len, texts)])[:-1], len(values)


def best_common(short: list[str], long_: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts the best likeness of the short one (of 1 to 64 characters) to any stretch of the long one of its length, or, with whole, to all of it.

    Stretches of all pairs go side by side: each keeps the row of the common subsequence as the bits of one number, and all
    rows take their next character at once. Stretches that end early lie last, so those that go on are a slice.
    """
    n = len(short)
    codes, begin, kinds = _codes([*short, *long_])
    m, size = np.array([len(x) for x in short]), np.array([len(x) for x in long_])
    places = np.zeros(n * kinds, np.uint64)
    of = np.repeat(np.arange(n), m)
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    np.bitwise_or.at(places, of * kinds + codes[: m.sum()], np.uint64(1) << at.astype(np.uint64))
    begin = begin[n:]
    if whole:
        pair, low, length = np.arange(n), begin, size
    else:
        count = size + m - 1
        pair = np.repeat(np.arange(n), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1 - m[pair]
        low = np.maximum(start, 0)
        length = np.minimum(start + m[pair], size[pair]) - low
        low = low + begin[pair]
    order = np.argsort(-length, kind="stable")
    pair, low, length = pair[order], low[order], length[order]
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - m.astype(np.uint64))
    row, table = full[pair], pair * kinds
    going = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # how many stretches are longer than j
    for j, k in enumerate(going.tolist()):
        hit = row[:k] & places[table[:k] + codes[low[:k] + j]]
        row[:k] = (row[:k] + hit) | (row[:k] - hit)
    common = m[pair] - np.bitwise_count(row & full[pair]).astype(np.int64)
    out = np.zeros(n)
    np.maximum.at(out, pair, 200.0 * common / (m[pair] + length))
    return out, m


def scores(project: list[str], finding: list[str], sentence: list[str]) -> np.ndarray:
    """score() of many rows in lower case; rows whose shorter text is empty or over 64 characters are scored one by one."""
    out = np.full(len(project), -1.0)
    looked = [(p, f) if f else (p[:HEAD], s) for p, f, s in zip(project, finding, sentence)]
    part = [(a, b) if len(a) <= len(b) else (b, a) for a, b in looked]
    words = lambda x: " ".join(sorted(x.split()))
    turned = [tuple(sorted(map(words, x), key=len)) if f else ("", "") for x, f in zip(looked, finding)]
    for texts, whole in ((part, False), (turned, True)):
        fits = [i for i, (a, _) in enumerate(texts) if 0 < len(a) <= WORD]
        held, size = [], 0
        for k, i in enumerate(fits):
            held.append(i)
            size += 1 if whole else len(texts[i][0]) + len(texts[i][1])
            if size >= AT_ONCE or len(held) >= 20_000 or k + 1 == len(fits):
                best, _ = best_common([texts[j][0] for j in held], [texts[j][1] for j in held], whole)
                out[held] = np.maximum(out[held], best)
                held, size = [], 0
        for i, (a, b) in enumerate(texts):
            if len(a) > WORD or not a and (not whole or finding[i]):
                out[i] = max(out[i], sorted_likeness(*looked[i]) if whole else part_likeness(*looked[i]))
    return out


@F.pandas_udf(DoubleType())
def _scores(project: pd.Series, finding: pd.Series, sentence: pd.Series) -> pd.Series:
    return pd.Series(scores(project.tolist(), finding.tolist(), sentence.tolist()))


_scores = _scores.asNondeterministic()  # else the optimiser has the scores made once for the filter and once more for the result


COUNTED = StructType([StructField(c, LongType()) for c in ("c0", "c1", "c2", "over", "size", "wide")])


@F.pandas_udf(COUNTED)
def _counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The characters of a text, counted by kind: as many bits as there are characters of a kind, 6 at most, packed into three numbers; the rest as their number; the text's length, and that of its words with one blank between."""
    for batch in texts:
        rows = []
        for x in batch:
            n = np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % KINDS, minlength=KINDS)
            bits = sum(((1 << min(int(c), EACH)) - 1) << EACH * k for k, c in enumerate(n.tolist()))
            cut = [(bits >> 64 * k & (1 << 64) - 1) for k in range(3)]
            rows.append((*(v - (1 << 64) if v >> 63 else v for v in cut), int(np.maximum(n - EACH, 0).sum()), len(x), len(" ".join(x.split()))))
        yield pd.DataFrame(rows, columns=["c0", "c1", "c2", "over", "size", "wide"])


def most_likely(a: str, b: str, named: Column) -> Column:
    """What score() can't be over, from counts of characters alone: a common subsequence has no more of a kind than either text. a, b: columns as _counted() makes them."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    shared = F.least(x("over"), y("over"))
    for k in ("c0", "c1", "c2"):
        shared = shared + F.bit_count(x(k).bitwiseAND(y(k)))
    m = F.least(x("size"), y("size"), F.when(named, x("size")).otherwise(HEAD))
    shared = shared.cast("double")
    part = F.when(m == 0, 100.0).otherwise(200 * F.least(shared, m) / (m + F.least(shared, m)))  # a stretch that is cut off by an edge is as long as what it shares
    return F.when(named, F.greatest(part, F.when(x("wide") + y("wide") > 0, 200 * shared / (x("wide") + y("wide"))).otherwise(100.0))).otherwise(part)


def candidates(projects: DataFrame, findings: DataFrame, key: str = "county", least: float = LEAST) -> DataFrame:
    """(key, _p, _f, _s): the different names that meet in a county and could reach `least`. A county's names are dealt to as many tasks as its pairs ask for, and only pairs that may be alike leave the join."""
    p = projects.select(key, F.lower(F.coalesce("project_name", F.lit(""))).alias("_p")).distinct().where(F.col(key).isNotNull())
    named = F.lower(F.coalesce("finding_name", F.lit("")))
    f = findings.select(key, named.alias("_f"), F.when(named != "", "").otherwise(F.lower(F.coalesce("sentence", F.lit("")))).alias("_s")).distinct().where(F.col(key).isNotNull())  # a named finding is scored by its name alone
    count = lambda d, name: d.groupBy(key).agg(F.count("*").alias(name))
    salts = count(p, "_np").join(count(f, "_nf"), key).select(key, F.least(F.col("_np"), F.ceil(F.col("_np") * F.col("_nf") / PAIRS)).cast("int").alias("_n"))
    left = p.join(salts, key).select(key, "_p", F.pmod(F.xxhash64("_p"), F.col("_n")).cast("int").alias("_salt"), _counted("_p").alias("_x"))
    right = f.select(key, "_f", "_s", _counted(F.when(F.col("_f") != "", F.col("_f")).otherwise(F.col("_s"))).alias("_y")).join(salts, key)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n").withColumnRenamed(key, "_key")
    near = most_likely("_x", "_y", F.col("_f") != "") >= least - 1e-3
    return left.join(right, (F.col(key) == F.col("_key")) & (left["_salt"] == right["_salt"]) & near).select(key, "_p", "_f", "_s")


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _with_names(projects: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the names by which they are compared: _p; _f, and _s where a finding has no name."""
    f = findings.withColumn("_f", _lower("finding_name"))
    return projects.withColumn("_p", _lower("project_name")), f.withColumn("_s", F.when(F.col("_f") != "", "").otherwise(_lower("sentence")))


def alike(p: DataFrame, f: DataFrame, key: str = "county", least: float = LEAST) -> DataFrame:
    """(key, _p, _f, _s, score): the different names of one county that are alike enough; each pair of them is scored once, wherever it occurs. p, f: as _with_names() makes them."""
    tasks = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be coalesced
    names = candidates(p, f, key, least)
    scored = names.select("_p", "_f", "_s").distinct().repartition(tasks, "_p", "_f", "_s").withColumn("score", F.round(_scores("_p", "_f", "_s"), 4)).where(F.col("score") >= least)
    # a county's rows of one name are many where its names are few: they meet the scored names, not each other's counties
    return p.select(key, "_p").distinct().join(scored, "_p").join(f.select(key, "_f", "_s").distinct(), [key, "_f", "_s"])


#: Links that a task makes, about.
LINKS = 2_000_000


def links(projects: DataFrame, findings: DataFrame, key: str = "county", least: float = LEAST) -> DataFrame:
    """All pairs of one county whose names are alike enough. projects: key, project_idx, project_name; findings: key, finding_idx, finding_name, sentence, kind. Names are compared in lower case; rows without a county have no links.

    Names that are alike are few, their links as many as the products of their rows. Links are counted by the finding's name
    first, and are made in as many tasks as that asks for; a name of many links goes to several.
    """
    p, f = _with_names(projects, findings)
    name = [key, "_f", "_s"]
    names = cut(alike(p, f, key, least))
    rows = names.join(p.groupBy(key, "_p").agg(F.count("*").alias("_m")), [key, "_p"]).groupBy(*name).agg(F.sum("_m").alias("_m"))
    made = cut(rows.join(f.groupBy(*name).agg(F.count("*").alias("_n")), name).select(*name, (F.col("_m") * F.col("_n")).alias("_made")))
    tasks = max(p.sparkSession.sparkContext.defaultParallelism, -(-(made.agg(F.sum("_made")).first()[0] or 0) // LINKS))
    salts = made.select(*name, F.ceil(F.col("_made") / LINKS).cast("int").alias("_salts"))
    left = p.join(names.join(salts, name), [key, "_p"]).withColumn("_salt", F.pmod(F.xxhash64(*projects.columns), F.col("_salts")).cast("int"))
    right = f.join(salts, name).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    by = [*name, "_salt"]
    return joined(left.repartition(tasks, *by), right.drop("_salts").repartition(tasks, *by), by).drop("_p", "_f", "_s", "_salts", "_salt")


def unlinked(findings: DataFrame, found: DataFrame, key: str = "county") -> DataFrame:
    """The named findings that no project is linked to."""
    return findings.where("coalesce(finding_name, '') <> ''").join(found.select(key, "finding_idx").distinct(), [key, "finding_idx"], "left_anti")


def triangulated(projects: DataFrame, findings: DataFrame, key: str = "county", least: float = LEAST) -> DataFrame:
    """Each project judged by the findings whose names are alike; then the named findings that no project matched. As judged() with links(), but names are judged, and projects take what their names have: no link is made."""
    p, f = _with_names(projects, findings)
    name = [key, "_f", "_s"]
    names = cut(alike(p, f, key, least))
    of = f.groupBy(*name).agg(F.collect_set("kind").alias("_kinds"), F.collect_list("finding_idx").alias("_findings"), F.min("finding_idx").alias("_first"))
    per = names.join(of, name).groupBy(key, "_p").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_kinds")))).alias("risks"), F.sort_array(F.flatten(F.collect_list("_findings"))).alias("findings"), F.min_by("score", "_first").alias("match_confidence")
    )
    return _verdicts(p.join(per, [key, "_p"], "left"), unlinked(findings, f.join(names, name, "left_semi"), key), key)


def judged(projects: DataFrame, findings: DataFrame, found: DataFrame, key: str = "county") -> DataFrame:
    """Each project with its verdict, risks, findings and the score of its first match, by links as links() finds them (key, project_idx, finding_idx, kind, score); then the named findings that none has."""
    per = found.groupBy(key, "project_idx").agg(
        F.array_sort(F.collect_set("kind")).alias("risks"), F.sort_array(F.collect_list("finding_idx")).alias("findings"), F.min_by("score", "finding_idx").alias("match_confidence")
    )
    return _verdicts(projects.join(per, [key, "project_idx"], "left"), unlinked(findings, found, key), key)


def _verdicts(d: DataFrame, unmatched: DataFrame, key: str) -> DataFrame:
    """Projects with what they are judged by, then the findings that none has."""
    severe = F.coalesce(F.arrays_overlap("risks", F.array(*map(F.lit, SEVERE))), F.lit(False))
    listed = d.select(key, "project_idx", "project_name", "risks", "findings", "match_confidence", verdict(F.col("risks").isNotNull(), severe, absorption(F.col("implementation_pct"))).alias("verdict"))
    only = unmatched.select(
        key, F.lit(None).cast("long").alias("project_idx"), F.col("finding_name").alias("project_name"), F.array("kind").alias("risks"), F.array("finding_idx").alias("findings"),
        F.lit(None).cast("double").alias("match_confidence"), F.lit("OAG_ONLY_PROJECT_FLAG").alias("verdict"),
    )
    return listed.unionByName(only)
