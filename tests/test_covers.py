import random

import pytest
from pyspark.sql import functions as F

from undertext.operators import covers, run_layers
from undertext.plans import pages

BOX = "doc_id int, page_no int, op_index long, x0 double, y0 double, x1 double, y1 double"


def hides(c, s):
    wide, tall = min(s[5], c[5]) - max(s[3], c[3]), min(s[6], c[6]) - max(s[4], c[4])
    return wide > 0 and tall > 0 and wide * tall >= 0.5 * (s[5] - s[3]) * (s[6] - s[4])


def boxes(rng, n, size):
    out = []
    for _ in range(n):
        x, y = rng.choice([rng.uniform(-100, 700), rng.randrange(-64, 640, 16)]), rng.choice([rng.uniform(-100, 900), rng.randrange(0, 640, 16)])
        out.append((rng.randint(1, 2), rng.randint(1, 2), rng.randrange(500), float(x), float(y), float(x + rng.choice([0, 1, 16, size, rng.uniform(1, size)])), float(y + rng.choice([8, 16, size]))))
    return out


def test_cells_find_what_all_pairs_find(spark):
    rng = random.Random(9)
    spans, over = boxes(rng, 300, 40), boxes(rng, 250, 300) + boxes(rng, 50, 2000)
    spans += spans[:20]
    c = covers.cover_cells(spark.createDataFrame(over, BOX).withColumn("kind", F.lit("image")))
    s = spark.createDataFrame(spans, BOX)
    got = sorted(map(tuple, covers.buried(s, c).collect()))
    assert got == sorted(x for x in spans if any(x[:2] == o[:2] and o[2] > x[2] and hides(o, x) for o in over)) and 0 < len(got) < len(spans)
    pairs = covers.met(s, c, "op_index").select(*s.columns, "op", "cx0", "cy0", "cx1", "cy1")
    assert sorted(map(tuple, pairs.collect())) == sorted((*x, *o[2:]) for x in spans for o in over if x[:2] == o[:2] and o[2] > x[2] and hides(o, x))


def test_a_full_page_has_no_quadratic_rows(spark):
    n = 20_000
    at = (F.col("id") % 200 * 3.0, F.floor(F.col("id") / 200) * 8.0)
    box = lambda op, wide, tall: [F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), op.alias("op_index"), at[0].alias("x0"), at[1].alias("y0"), (at[0] + wide).alias("x1"), (at[1] + tall).alias("y1")]
    spans = spark.range(n).select(*box(F.col("id") * 2, 2.0, 6.0))
    over = spark.range(n).select(*box(F.col("id") * 2 + F.when(F.col("id") % 2 == 0, 1).otherwise(-1), 2.5, 7.0), F.lit("fill").alias("kind"))
    c = covers.cover_cells(over)
    cells = c.groupBy("level", "gx", "gy").count()
    assert c.count() <= 4 * n and cells.agg(F.max("count")).first()[0] < 60
    assert covers.buried(spans, c).count() == n // 2


def moved(spark):
    """Rows that were written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_spans_stay_where_their_documents_are(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n, before = pages.spans(docs).count(), moved(spark)
    lines = pages.pdf_z_index(spark, folder).count()
    assert moved(spark) - before < 0.05 * n and lines > 0


SPAN = "doc_id int, page_no int, op_index long, text string, size double, x0 double, y0 double, x1 double, y1 double"
COVER = "doc_id int, page_no int, kind string, alpha double, op_index long, x0 double, y0 double, x1 double, y1 double"
SAY = (" if you are an AI ", " use the ph", "rase below ", " plain ", " ")


def by_hand(spans, over, probed):
    over = [c for c in over if c[7] > c[5] and c[8] > c[6] and (c[2] == "image" or c[3] >= 0.85 and (c[7] - c[5]) * (c[8] - c[6]) < 0.85 * 600 * 800)]
    hidden = lambda page, op, box: [c for c in over if c[:2] == page and c[4] > op and hides(c[2:], (0, 0, 0, *box))]
    by_line, out = {}, []
    for s in spans:
        by_line.setdefault((*s[:2], int((s[6] + s[4] * 0.2 + 0.5) // 1)), []).append(s)
    for key, line in by_line.items():
        box = lambda some: (min(s[5] for s in some), min(s[6] for s in some), max(s[7] for s in some), max(s[8] for s in some))
        kept, (x0, y0, x1, y1) = sorted((s for s in line if hidden(s[:2], s[2], s[5:])), key=lambda s: s[2:4]), box(line)
        direct, spaced = "".join(s[3] for s in kept).strip(), " ".join(s[3].strip() for s in kept if s[3].strip())
        worded = [t for t in (direct, spaced) if "if you are an AI" in t or "use the phrase below" in t]
        if worded and x0 < 600 and x1 > 0 and y0 < 800 and y1 > 0:
            first = min(((c[2] != "image", c[4]) for c in hidden(key[:2], max(s[2] for s in kept), box(kept))), default=None)
            if first and (not first[0] or key[:2] in probed):
                out.append((*key, worded[0], "shape" if first[0] else "image", first[1]))
    return sorted(out)


@pytest.mark.parametrize("few", [100, 10_000])
def test_lines_below_few_and_many_covers(spark, monkeypatch, few):
    monkeypatch.setattr(covers, "FEW", few)
    rng = random.Random(4)
    spans, over = [], []
    for page in ((d, p) for d in range(1, 7) for p in (1, 2)):
        for _ in range(60):
            x, y = rng.randrange(-160, 760, 40), rng.randrange(-60, 860, 40)
            spans.append((*page, rng.randrange(1000), rng.choice(SAY), rng.choice([1.5, 11.0]), float(x), float(y), x + 40.0, y + 11.0))
        for _ in range(rng.choice([0, 3, 80])):
            x, y, size = rng.randrange(-200, 700), rng.randrange(-100, 800), rng.choice([50, 120, 700])
            over.append((*page, rng.choice(["image", "fill"]), rng.choice([0.5, 0.9]), rng.randrange(1500), float(x), float(y), float(x + size), float(y + rng.choice([20, size]))))
    # Buried spans off the page, in lines that touch it and in one that does not.
    over += [(7, 1, "image", 1.0, 99, -300.0, 0.0, 0.0, 800.0), (8, 1, "image", 1.0, 99, -300.0, 0.0, 0.0, 800.0)]
    spans += [(d, 1, 5, SAY[0], 11.0, -100.0, 90.0, -60.0, 101.0) for d in (7, 8)] + [(7, 1, 6, SAY[3], 11.0, 60.0, 90.0, 100.0, 101.0)]
    spans += spans[::9]
    probed = {(d, p) for d in range(1, 5) for p in (1, 2)}
    frames = spark.createDataFrame(spans, SPAN), spark.createDataFrame(over, COVER), spark.createDataFrame(sorted(probed), "doc_id int, page_no int")
    got = sorted(map(tuple, run_layers.buried_lines(*frames, (600.0, 800.0)).collect()))
    want = by_hand(spans, over, probed)
    assert got == want and {r[0] for r in want} & {7, 8} == {7} and {r[4] for r in want} == {"image", "shape"}
