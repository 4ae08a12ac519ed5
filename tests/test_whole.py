"""Queries without SQL, over all rows, against brute force."""

from fiscalis import catalogue
from fiscalis.operators import scoring, tables, triangulate
from fiscalis.plans import pages

def test_kept_boxes_of_all_pages(spark, data):
    of = {}
    for r in pages._boxes(lambda name: spark.read.parquet(f"{data}/{name}.parquet")).collect():
        of.setdefault(r.page, []).append(((r.y1 + r.y2) / 2, r.idx, r.x1, r.y1, r.x2, r.y2, float(r.score)))
    want = set()
    for page, boxes in of.items():
        kept: list = []
        for b in sorted(boxes):
            a = kept[-1] if kept else b
            both = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
            if not kept or both / min((x[4] - x[2]) * (x[5] - x[3]) for x in (a, b)) < 0.7:
                kept.append(b)
            elif b[6] > a[6]:
                kept[-1] = b
        want |= {(page, k[1]) for k in kept}
    assert {(r.page, r.idx) for r in catalogue.queries()["geo_box_dedupe"](spark, data).collect()} == want


def test_greedy_match_of_all_pages(spark, data):
    rows = catalogue.queries()["geo_iou_pairs"](spark, data).collect()
    want, used = set(), set()
    for r in sorted(rows, key=lambda r: (-r.iou, r.idx, r.b_idx)):
        if not used & {(r.page, "a", r.idx), (r.page, "b", r.b_idx)}:
            used |= {(r.page, "a", r.idx), (r.page, "b", r.b_idx)}
            want.add((r.page, r.idx, r.b_idx))
    assert {(r.page, r.a, r.b) for r in catalogue.queries()["geo_greedy_match"](spark, data).collect()} == want


def test_every_part_is_linked(spark, data):
    p, f = (d.collect() for d in pages._named(lambda name: spark.read.parquet(f"{data}/{name}.parquet")))
    parts = [r.p_partkey for r in spark.read.parquet(f"{data}/part.parquet").collect()]
    assert sorted([r.project_idx for r in p] + [r.finding_idx for r in f]) == sorted(parts)
    scored = {(a.project_idx, b.finding_idx): triangulate.score(a.project_name, b.finding_name, b.sentence) for a in p for b in f if a.county == b.county}
    got = {(r.project_idx, r.finding_idx): r.score for r in catalogue.queries()["tri_fuzzy_link"](spark, data).collect()}
    assert got == {k: round(v, 4) for k, v in scored.items() if round(v, 4) >= triangulate.LEAST}
    verdicts = catalogue.queries()["tri_verdicts"](spark, data).collect()
    assert sorted(r.project_idx for r in verdicts if r.project_idx is not None) == sorted(r.project_idx for r in p)


def test_names_wherever_they_begin(spark, tmp_path):
    items = ["Thing.\nErlyeash of the old road", "open road to the sea side", "word", "two words", "", None, " a  b  c ", "a b c d e"]
    texts = ["x Thing.\nErlyeash of the old road y", "(open road to the sea side)", "\topen road to the sea sides", "sword", "two words two words", "", None, "x a  b  c  y", "a b c d e a b c d e", "a b c d", "a b c d e a b c d e"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.item_id, r.doc_id) for r in catalogue.queries()["name_contains"](spark, str(tmp_path)).collect())
    assert got == [(i, k) for i, x in enumerate(items) for k, y in enumerate(texts) if x is not None and y is not None and x in y]


def test_few_pairs_are_scored(spark, data):
    rows = catalogue.queries()["tri_pair_counts"](spark, data).collect()
    links = catalogue.queries()["tri_fuzzy_link"](spark, data).groupBy("county").count().collect()
    assert {r.county: r.links for r in rows if r.links} == {r.county: r["count"] for r in links}
    assert sum(r.looked_at for r in rows) < 0.95 * sum(r.pairs for r in rows)


def test_likeness_of_any_texts():
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(0, 12)))
    text = lambda n: " ".join(word() for _ in range(r.randint(0, n)))
    rows = [(text(r.choice([4, 4, 4, 30])), r.choice(["", text(4), text(25)]), text(20)) for _ in range(1500)] + [("", "", ""), ("a" * 64, "a" * 64, ""), ("a" * 65, "b" * 70, ""), ("x", "", "y" * 3000)]
    for got, row in zip(triangulate.scores(*map(list, zip(*rows))), rows):
        assert abs(got - triangulate.score(*row)) < 1e-9


def test_bound_is_never_under_the_score(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh  ıǆß\U0001f600") for _ in range(r.randint(0, n)))
    rows = [(text(90), r.choice(["", text(40), text(90)]), text(120)) for _ in range(1500)]
    d = spark.createDataFrame(rows, "p string, f string, s string").select(*(F.lower(c).alias(c) for c in ("p", "f", "s")))
    d = d.select("*", triangulate._counted("p").alias("x"), triangulate._counted(F.when(F.col("f") != "", F.col("f")).otherwise(F.col("s"))).alias("y"))
    for row in d.select("p", "f", "s", triangulate.most_likely("x", "y", F.col("f") != "").alias("most")).collect():
        assert row.most >= triangulate.score(row.p, row.f, row.s) - 1e-9, row


def test_large_pages_are_matched_in_rounds(spark):
    """Pages with more candidates than a row holds, ties among them, against a loop; and the fold and the rounds agree."""
    import random

    r = random.Random(6)
    rows = [(page, a, b, r.choice([0.5, 0.6, r.random()])) for page, n in ((1, 120), (2, 12), (None, 30)) for a in range(n) for b in range(n)]
    d = spark.createDataFrame(rows, "page int, a long, b long, iou double").repartition(4)
    want, used = set(), set()
    for page, a, b, x in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if not used & {(page, "a", a), (page, "b", b)}:
            used |= {(page, "a", a), (page, "b", b)}
            want.add((page, a, b, x))
    for folded in (1, 500, 10**6):
        assert {tuple(x) for x in scoring.greedy_pairs(d, ["page"], folded).collect()} == want
    assert scoring.greedy_pairs(d.limit(0), ["page"]).count() == 0


def test_a_dense_page_is_cut_into_tiles(spark):
    """100,000 words and as many cells on one page: each word meets its own cell, and few others are compared."""
    from pyspark.sql import functions as F

    n = 320
    at = spark.range(n * n).select(F.lit(1).alias("page"), F.col("id").alias("idx"), (F.col("id") % n * 10).alias("x"), F.floor(F.col("id") / n).alias("row")).withColumn("y", F.col("row") * 8)
    cells = at.select("page", "idx", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 10).alias("x2"), (F.col("y") + 8).alias("y2"))
    words = at.select("page", F.col("idx").alias("word_idx"), F.lit("w").alias("text"), (F.col("x") + 2).alias("x1"), (F.col("y") + 2).alias("y1"), (F.col("x") + 8).alias("x2"), (F.col("y") + 6).alias("y2"))
    found = tables.words_in_cells(words, cells, ["page"], "idx")
    assert found.agg(F.count("*"), F.sum("n_words"), F.max("n_words")).first() == (n * n, n * n, 1)
    g = tables._page_tiles(words, cells, ["page"]).first()
    assert g._g == 160 and g._w == n * 10 / 160 and g._h == n * 8 / 160  # 4 cells and 4 words to a tile


def test_meeting_boxes_of_any_size(spark):
    """Large and small, touching, empty, turned and null boxes, at negative places, each pair once, with one and many tiles."""
    import random

    r = random.Random(8)

    def boxes(n):
        out = []
        for k in range(n):
            x, y, s = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0, 1, 5, 100, -3])
            out.append((r.choice([1, None]), k, x, y, x + s * r.random(), y + s, None if k % 17 == 0 else 1.0))
        out += [(1, n + k, 10.0 * k, 0.0, 10.0 * k + 10, 10.0, 1.0) for k in range(5)]
        return [(p, k, x1 if q else None, *z) for p, k, x1, *z, q in out]

    schema = "page int, idx int, x1 double, y1 double, x2 double, y2 double"
    a, b = boxes(200), boxes(150)
    want = {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and None not in (x[2], y[2]) and min(x[4], y[4]) > max(x[2], y[2]) and min(x[5], y[5]) > max(x[3], y[3])}
    A, B = (spark.createDataFrame(d, schema) for d in (a, b))
    for few in (1, 10**9):
        was, tables.FEW_PAIRS = tables.FEW_PAIRS, few
        got = [(x.page, x.idx, x.b_idx) for x in tables.meeting(A, B, ["page"]).collect()]
        tables.FEW_PAIRS = was
        assert len(got) == len(want) and set(got) == want


def test_many_boxes_are_folded(spark):
    """A page of 50,000 boxes against a loop."""
    import random

    r = random.Random(9)
    rows = [(1, k, float(r.randint(0, 3)), k * 0.3 + r.random(), 100.0, k * 0.3 + r.choice([2.0, 5.0]), float(r.randint(0, 9))) for k in range(50_000)]
    d = spark.createDataFrame(rows, "page int, idx int, x1 double, y1 double, x2 double, y2 double, score double")
    kept: list = []
    for b in sorted(((x[3] + x[5]) / 2, *x[1:]) for x in rows):
        a = kept[-1] if kept else None
        if a:
            both = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
            if both / min((x[4] - x[2]) * (x[5] - x[3]) for x in (a, b)) >= 0.7:
                if b[6] > a[6]:
                    kept[-1] = b
                continue
        kept.append(b)
    from pyspark.sql import functions as F

    got = tables.kept_boxes(d.withColumn("c", (F.col("y1") + F.col("y2")) / 2), ["page"], "c", "idx").select("idx").collect()
    assert sorted(x.idx for x in got) == sorted(k[1] for k in kept) and len(kept) < 50_000
