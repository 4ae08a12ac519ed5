"""Secrets: patterns of known kinds, and character Markov models of random strings against ordinary identifiers.

Everything on the data is a Spark expression over one text at a time; nothing is shuffled. The two models are first-order
chains over the characters of ALPHABET, trained from labelled samples; their log-likelihood ratio is kept as a table of
whole thousandths, so that sums are exact and don't depend on their order.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import before_each, table
from fiscalis.sources.tables import spread

#: The kinds, in the order in which equal starts are listed, with pattern, group that is measured and its least length.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
#: The patterns with the least length inside: a text that doesn't match has no such span, so the costlier search is skipped.
HINTS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "markov": r"[A-Za-z0-9+/_-]{20}",
}
METHOD = "markov"
CANDIDATE = r"([A-Za-z0-9+/_-]+)"
#: The same where a run that is too short can be passed over at once, as no other match begins inside it.
SEARCH = {"access": r"(AKIA[A-Z0-9]{16,})", "hex": r"([0-9a-f]{24,})", "markov": r"([A-Za-z0-9+/_-]{20,})"}
SHORTEST = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Thousandths of a nat per character that a candidate needs.
LEAST_RATIO = 500
#: Words of the ordinary samples: of code, and of other languages than English.
WORDS = (
    "account action address amount array asset audit balance base batch block buffer build cache call category channel check child class client code column commit config connection content "
    "context control convert count create current data date default delete detail device document domain element email engine entry error event example export factory field file filter "
    "folder format function generate group handler header history index input instance interface internal invoice item kernel language layer length letter level library limit line list "
    "local location manager mapping market master matrix measure member memory message method model module monitor name network node notification number object office operation option "
    "order output package page parent partition payment person place plan policy port position process product profile project property provider query queue range record reference region "
    "register release report request resource response result return review route schedule schema search section sequence server service session setting shadow signal size source stage "
    "standard state status storage stream string structure summary support switch system table target task template thread time title transaction transfer update upload value vector version "
    "view warning window worker"
).split()


OTHER_WORDS = (
    "abteilung aufgabe ausgabe beispiel bericht bestellung daten eingabe ergebnis fehler gemeinde geschichte gesellschaft haushalt jahr kunde land leistung menge rechnung stadt steuer strasse vertrag verwaltung "
    "adresse bureau chemin commande compte conseil demande depense document donnees entreprise exemple facture gouvernement histoire ligne liste marche modele nombre page pays projet region reponse service ville "
    "archivo ayuda calidad ciudad cliente codigo comercio consulta cuenta departamento desarrollo ejemplo empresa entrada fecha gobierno historia linea mensaje nombre palabra pedido precio presupuesto registro salida"
).split()
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop")
_HEX, _UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _drawn(letters: str, least: int = 20, most: int = 44):
    return lambda r, w: "".join(r.choice(letters) for _ in range(r.randint(least, most)))


#: How samples of each kind are made from a random generator and some words.
RANDOM = {
    "letters and digits": _drawn(ALPHABET[:62]), "hexadecimal": _drawn(_HEX), "base64": _drawn(ALPHABET[:64]), "capitals and digits": _drawn(_UPPER),
    "small letters and digits": _drawn("abcdefghijklmnopqrstuvwxyz0123456789"), "base64 for addresses": _drawn(ALPHABET[:62] + "-_"),
    "uuid": lambda r, w: "-".join(_drawn(_HEX, n, n)(r, w) for n in (8, 4, 4, 4, 12)),
    "pieces with a name": lambda r, w: f"{w[0]}_{_drawn(ALPHABET[:62], 24, 40)(r, w)}",
}
ORDINARY = {
    "snake": lambda r, w: "_".join(w), "camel": lambda r, w: "".join(x.title() for x in w), "kebab": lambda r, w: "-".join(w) + (f"-{r.randint(0, 99)}" if r.random() < 0.3 else ""),
    "path": lambda r, w: "/" + "/".join(w), "constant": lambda r, w: "_".join(w).upper() + (f"_{r.randint(0, 2030)}" if r.random() < 0.3 else ""), "compound": lambda r, w: "".join(w),
    "rule line": lambda r, w: (r.choice("-_+/") if r.random() < 0.7 else r.choice(("-+", "-_", "+/", "_/", "--+--"))) * r.randint(20, 60),
    "date": lambda r, w: f"{r.randint(1950, 2035)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" + r.choice(("/", "_", "-", "T")) + w[0] + r.choice(("", f"-{r.randint(1, 99):02d}")),
    "keys in a row": lambda r, w: "".join(r.choice(KEYBOARD) for _ in range(r.randint(2, 4))),
    "dated path": lambda r, w: "/".join((w[0], str(r.randint(1990, 2035)), f"{r.randint(1, 12):02d}", "-".join(w[1:]))),
    "doubled": lambda r, w: (w[0] + r.choice(("", "-", "_"))) * r.randint(3, 8),
    "number": lambda r, w: r.choice("0123456789") * r.randint(4, 30) + str(r.randint(0, 9999)),
}


def labelled_samples(n: int = 9600, seed: int = 7, left_out: str | None = None) -> list[tuple[str, bool]]:
    """Samples of both kinds, made by rule: (string, whether it is random). A style can be left out, to test on it what the others teach."""
    r = random.Random(seed)
    out = []
    for label, styles in ((True, RANDOM), (False, ORDINARY)):
        names = [k for k in styles if k != left_out]
        for i in range(n):
            pool = OTHER_WORDS if r.random() < 0.4 else WORDS
            out.append((styles[names[i % len(names)]](r, [r.choice(pool) for _ in range(r.randint(2, 5))]), label))
    return out


def train(samples: list[tuple[str, bool]], smoothing: float = 0.5) -> list[int]:
    """The ratio table: for each state (0 the start, else the character before, by its place in ALPHABET) and each character, thousandths of log P(random) - log P(ordinary)."""
    m = len(ALPHABET)
    place = {c: k + 1 for k, c in enumerate(ALPHABET)}
    logs = []
    for kind in (True, False):
        counts = [[smoothing] * m for _ in range(m + 1)]
        for text, label in samples:
            if label == kind:
                state = 0
                for c in text:
                    if c in place:
                        counts[state][place[c] - 1] += 1
                        state = place[c]
        logs.append([[math.log(x / sum(row)) for x in row] for row in counts])
    return [round(1000 * (a - b)) for x, y in zip(*logs) for a, b in zip(x, y)]


@lru_cache(1)
def default_table() -> tuple[int, ...]:
    return tuple(train(labelled_samples()))


def ratio(text: Column, table_: tuple[int, ...] | list[int]) -> Column:
    """Thousandths of the log-likelihood ratio of a string over ALPHABET."""
    m = len(ALPHABET)
    ratios = F.lit(",".join(map(str, table_)))
    ratios = F.split(ratios, ",").cast("array<int>")  # folded into a constant
    places = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("state"))
    step = lambda s, k: F.struct((s["sum"] + F.element_at(ratios, s["state"] * m + k)).cast("long").alias("sum"), k.alias("state"))
    return F.aggregate(places, start, step, lambda s: s["sum"])


_EMPTY = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The spans of the leftmost non-overlapping matches. The text between matches and the matches themselves take turns, so their lengths add up to places."""
    gaps = F.split(text, pattern, -1)
    match = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    parts = F.arrays_zip(gaps.alias("gap"), match.alias("match"), value.alias("value"))
    before = before_each(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))

    def span(x: Column, at: Column) -> Column:
        begin = at + F.length(x["gap"])
        return F.struct(begin.alias("start"), F.lit(rank).alias("kind"), (begin + F.length(x["match"])).alias("end"), x["value"].alias("value"))

    found = F.filter(F.zip_with(parts, before, span), lambda x: F.length(x["value"]) >= least)  # the last gap has no match
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(_EMPTY))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_: tuple[int, ...] | None = None, least_ratio: int = LEAST_RATIO, whole_rows: bool = False) -> DataFrame:
    """One row (id, text, base, found), with whole_rows also a struct `row` of all columns, per row of docs: the spans of the known kinds, and all spans, in the order of starts, then kinds; offsets in code points, ends exclusive.

    A candidate of 20 or more characters is a secret if its log-likelihood ratio is at least least_ratio per character; it
    may cover a span of a known kind too. Null texts count as empty: no spans. Repeated rows and ids stay rows of their
    own; null ids stay null.
    """
    row = [F.struct("*").alias("row")] if whole_rows else []
    d = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), *row)
    row = ["row"] if whole_rows else []
    each = [_spans(F.col("text"), kind, k, SEARCH.get(kind, rule[0]), *rule[1:]).alias(kind) for k, (kind, rule) in enumerate(KINDS.items())]
    maybe = _spans(F.col("text"), METHOD, len(KINDS), SEARCH[METHOD], 1, SHORTEST).alias("maybe")
    d = d.select("id", "text", *row, *each, maybe)
    d = d.withColumn(METHOD, F.filter("maybe", lambda s: ratio(s["value"], table_ or default_table()) >= least_ratio * F.length(s["value"])))
    ordered = lambda *names: F.array_sort(F.concat(*(F.transform(n, lambda s: F.struct(s["start"], s["kind"], s["end"])) for n in names)))
    return d.select("id", "text", ordered(*KINDS).alias("base"), ordered(*KINDS, METHOD).alias("found"), *row)


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, [*KINDS, METHOD]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.array(F.substring(F.col(text), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit(mark)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when((x["start"] >= s["at"]) & (x["end"] > s["at"]), fresh).otherwise(s["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(text), s["at"] + 1, F.length(text))))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of all documents, by patterns and by models."""
    found = scan(spread(table(spark, sf_dir, "documents")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"),
    )


def oracle() -> str:
    """The query in DuckDB's SQL, with the ratio table written into it."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    m = len(ALPHABET)
    rules = {**KINDS, METHOD: (CANDIDATE, 1, SHORTEST)}
    lists, spans = [], []
    for k, (kind, (pattern, group, least)) in enumerate(rules.items()):
        lists.append(
            f"regexp_extract_all(t, {quoted(rf'(?s)(.*?)({pattern})')}, 0) AS {kind}_w, regexp_extract_all(t, {quoted(f'({pattern})')}, 1) AS {kind}_m, regexp_extract_all(t, {quoted(f'({pattern})')}, {group + 1}) AS {kind}_v"
        )
        spans.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, list_sum(list_transform({kind}_w[1:i], lambda x: length(x)))::BIGINT AS e, length({kind}_m[i]) AS n, {kind}_v[i] AS v"
            f" FROM found, unnest(range(1, len({kind}_w) + 1)) AS u(i) WHERE length({kind}_v[i]) >= {least}"
        )
    ratio_ = (
        f"list_sum(list_transform(range(1, length(v) + 1), lambda j: r[(CASE WHEN j = 1 THEN 0 ELSE strpos('{ALPHABET}', v[j - 1:j - 1]) END) * {m} + strpos('{ALPHABET}', v[j:j])]))"
    )
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    ratios AS (SELECT [{", ".join(map(str, default_table()))}] AS r),
    found AS (SELECT doc_id, {", ".join(lists)} FROM d),
    spans AS ({" UNION ALL ".join(spans)}),
    real AS (SELECT doc_id, k, e - n AS s, kind || ':' || (e - n) || ':' || e AS x FROM spans, ratios WHERE kind <> '{METHOD}' OR {ratio_} >= {LEAST_RATIO} * length(v)),
    per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < {len(KINDS)}), '') AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM real GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per USING (doc_id)"""
