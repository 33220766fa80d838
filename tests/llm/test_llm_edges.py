"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import html_text, leaks, lines, mixing, near_dups, quality, sharding, substrings, urls, warc
from claimweave.llm.blocks import blocks_of, vectors
from claimweave.llm.components import components
from claimweave.llm.labeller import BlockLabeller

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ref string, digest string, n_words string, kept string, shard string, h string, band string"


def table(spark, rows):
    full = [(d, t, "en", s, 0, "ref", "digest", "w", "k", "s", "h", "b") for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    a, b = prose(60, 1), prose(60, 2)
    long = prose(60_000, 3)
    return [
        (1, a, "x"), (2, a, "x"), (2, a, "x"), (3, None, "x"), (4, "", None), (5, " \n\t ", "y"), (None, a, "y"), (None, b, None),
        (6, b + " tail", "y"), (7, "one two three", "y"), (8, long, "y"), (9, long + " end", "z"), (10, "é" * 30 + " ß " + b, "z"), (-5, b, "z"),
    ]


def test_substrings_by_brute_force(spark, odd):
    got = substrings.without_repeats(table(spark, odd), ["doc_id", "n_words"]).collect()
    order = sorted(range(len(odd)), key=lambda k: (odd[k][0] is None, odd[k][0] or 0))
    first, want = {}, []
    words = [(t or "").split() for _, t, _ in odd]
    for k in order:
        for i in range(len(words[k]) - 19):
            first.setdefault(tuple(words[k][i : i + 20]), (odd[k][:2], i))
    for k in range(len(odd)):
        gone = {p for i in range(len(words[k]) - 19) if first[tuple(words[k][i : i + 20])] != (odd[k][:2], i) for p in range(i, i + 20)}
        want.append((odd[k][0], len(words[k]), len(gone), " ".join(w for p, w in enumerate(words[k]) if p not in gone)))
    assert sorted(((r._c_doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == sorted(want, key=str)
    assert any(len(r.repeats) and r.repeats[0].end - r.repeats[0].start > 50_000 for r in got)


def test_substrings_of_overlapping_copies(spark):
    """Passages glued from parts of earlier ones, with repeats inside one text."""
    r = random.Random(7)
    pool = [prose(30, s) for s in range(6)]
    rows = [(k, " ".join(r.choice(pool)[r.randint(0, 40) :] for _ in range(r.randint(1, 6))), "s") for k in range(40)]
    got = {x._c_doc_id: x.kept_text for x in substrings.without_repeats(table(spark, rows), ["doc_id"]).collect()}
    seen = set()
    for k, t, _ in rows:
        w, gone = t.split(), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        assert got[k] == " ".join(x for p, x in enumerate(w) if p not in gone)


def test_quality(spark, odd):
    rows = quality.judged(table(spark, odd)).collect()
    assert len(rows) == len(odd) and {"in_n_words", "in_kept"} <= set(rows[0].asDict())
    by = {r.doc_id: r for r in rows}
    assert not by[3].kept and by[3].n_words == 0 and by[4].base_failed and by[5].n_words == 0 and by[8].n_words == 60_000
    assert by[1].kept and by[8].kept
    kept = quality.kept_documents(table(spark, odd))
    assert kept.columns == table(spark, odd).columns and kept.where("doc_id = 2").count() == 2
    assert quality.judged(table(spark, odd).limit(0)).count() == 0


def test_quality_rejects_a_bad_host_and_shrinks_a_small_one(spark):
    junk = "spam spam spam spam spam spam " * 5
    rows = [(k, prose(40, k), "good") for k in range(30)] + [(100 + k, junk if k < 28 else prose(40, k), "bad") for k in range(30)] + [(200, junk, "tiny"), (201, prose(40, 77), "tiny")]
    rows += [(300 + k, prose(40, 500 + k), f"s{k % 5}") for k in range(60)]
    kept = {r.doc_id for r in quality.judged(table(spark, rows)).where("kept").collect()}
    assert kept >= set(range(30)) | {201} and not kept & set(range(100, 131)) and 200 not in kept


def test_near_duplicates(spark, odd):
    rows = near_dups.with_class(table(spark, odd)).collect()
    cls = {(r._c_doc_id, r._c_text): r.class_id for r in rows}
    a, b = odd[0][1], odd[7][1]
    assert len(rows) == len(odd) and cls[1, a] == cls[2, a] == cls[None, a] == 1
    assert cls[9, odd[11][1]] == 8 and cls[-5, b] == cls[None, b] == cls[6, b + " tail"] == cls[10, odd[12][1]] == -5
    assert cls[3, None] == 3 and cls[4, ""] == 4 and cls[5, " \n\t "] == 5 and cls[7, "one two three"] == 7
    kept = near_dups.one_of_each(table(spark, odd))
    assert sorted(r.doc_id for r in kept.collect()) == [-5, 1, 3, 4, 5, 7, 8] and kept.columns == table(spark, odd).columns
    assert near_dups.with_class(table(spark, odd).limit(0)).count() == 0


def test_chains_of_links_stay_one_class(spark):
    """Each text is near the next only: three words change from one to the next, far ends share little."""
    rows = []
    for g in range(12):
        w = prose(80, 900 + g).split()
        for k in range(6):
            rows.append((100 * g + k, " ".join(w), "s"))
            w[k * 12 : k * 12 + 2] = [f"new{k}", f"word{k}"]
    got = {r._c_doc_id: r.class_id for r in near_dups.with_class(table(spark, rows)).collect()}
    assert all(c == d // 100 * 100 for d, c in got.items())


@pytest.mark.parametrize("part", [4096, 40])
def test_versions_of_a_template_equal_all_pairs(spark, monkeypatch, part):
    """Most versions are just under the threshold to each other, so few links stand for others of their class."""
    monkeypatch.setattr(near_dups, "PART_TEXTS", part)
    r = random.Random(11)
    base, rows = prose(254, 31).split(), []
    for k in range(300):
        w = list(base)
        for j in r.sample(range(2, 252), 4):
            w[j] = f"v{k}at{j}"
        rows.append((k, " ".join(w), "s"))
    bags = [near_dups._bag(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near_dups.similarity(bags[a], bags[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    got = {x._c_doc_id: x.class_id for x in near_dups.with_class(table(spark, rows)).collect()}
    assert len(set(root)) < len(rows) - 10 and got == dict(enumerate(root))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    doc = np.repeat([0, 1], 60)
    w = np.concatenate([a, b])
    on = w > 0
    s = near_dups.signatures(doc[on], np.concatenate([keys, keys])[on], w[on], 2, 20_000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, 300), (300, 250), (7, 7)] + [(400 + r.randint(0, 30), 400 + r.randint(0, 30)) for _ in range(40)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    linked = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(spark):
    block = "\n".join(prose(6, 40 + k) for k in range(12))
    rows = [(1, block, "s"), (2, "own line\n" + block + "\nlast", "s"), (2, "own line\n" + block + "\nlast", "s"), (3, None, "s"), (4, "\n\n\n", "s"), (5, "\n\n\n", "s"), (None, block, "s"), (6, "single", "s"), (7, "single", "s")]
    got = lines.without_repeats(table(spark, rows)).collect()
    by = {r._c_doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].n_removed_lines == 0 and by[1].kept_text == block
    assert by[2].n_removed_lines >= 6 and by[2].kept_text.startswith("own line") and by[None].n_removed_lines == 9  # three of its twelve lines are chunks by themselves, which stay
    assert by[3].kept_text == "" and by[4].kept_text == "\n\n\n" and by[5].n_removed_lines == 0 and by[7].kept_text == "single"
    assert lines.without_repeats(table(spark, rows).limit(0)).count() == 0


def test_mixing(spark, odd):
    rows = mixing.mixed(table(spark, odd), ["doc_id", "h"]).collect()
    assert len(rows) == len(odd) and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sum({(r.source_size, r.target): r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert mixing.mixture(table(spark, odd)).columns == table(spark, odd).columns
    assert mixing.mixed(table(spark, odd).limit(0), ["doc_id"]).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = [(k, prose(5 + k % 30, k), f"s{k % 4}" if k % 3 else "hot") for k in range(1500)]
    out = mixing.mixed(table(spark, rows), ["source"]).groupBy("_c_source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
    assert all(abs(r.t - r.x) <= 20 for r in out)


def test_sharding(spark, odd):
    rows = sharding.shuffled(table(spark, odd), 4).collect()
    assert len(rows) == len(odd) and {r.shard for r in rows} == {0, 1, 2, 3}
    assert sharding.shuffled(table(spark, odd).limit(0), 4).count() == 0
    m = sharding.communication_matrix([5, 0, 1000, 17], [256, 256, 255, 255], 1)
    assert [sum(x) for x in m] == [5, 0, 1000, 17] and [sum(x) for x in zip(*m)] == [256, 256, 255, 255]


def test_large_draws_have_the_hypergeometric_mean():
    rng = np.random.default_rng(2)
    x = [sharding._draw(rng, 3 * 10**9, 4 * 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(x) - 750) < 3 and 9 < np.std(x) < 19


def test_leaks(spark, odd):
    item = prose(40, 21)
    w = item.split()
    edited = " ".join(x for k, x in enumerate(w) if k % 9 != 4)
    docs = [*odd, (50, prose(200, 5) + " " + item.upper().replace(" ", ", ") + " " + prose(9, 6), "s"), (51, prose(30, 8) + " " + edited, "s"), (None, item, "s")]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (5, item)], "item_id long, text string")
    got = leaks.leaks(table(spark, docs), items, at_once=2).collect()
    assert sorted({(str(r.doc_id), r.item_id) for r in got}) == [("50", 1), ("50", 5), ("51", 1), ("51", 5), ("None", 1), ("None", 5)]
    hit = next(r for r in got if r.doc_id == 50)
    assert hit.score == 1.0 and (hit.start, hit.end) == (200, 240)
    clean = leaks.clean_documents(table(spark, docs), items)
    assert clean.count() == len(odd) and clean.columns == table(spark, docs).columns
    assert leaks.leaks(table(spark, docs), items.limit(0)).count() == 0


@pytest.mark.parametrize("nth", [4, 5])
def test_leaks_of_copies_with_every_nth_word_changed(spark, odd, nth):
    """Most grams of such a copy are changed and occur nowhere; the corpus holds the item in no other form."""
    texts = {k: prose(n, 700 + n) for k, n in enumerate((30, 40, 60))}
    changed = {k: " ".join(f"other{j}" if j % nth == nth - 1 else x for j, x in enumerate(t.split())) for k, t in texts.items()}
    docs = [*odd, *[(50 + k, f"{prose(50, 71 + k)} {t} {prose(50, 81 + k)}", "s") for k, t in changed.items()]]
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = leaks.leaks(table(spark, docs), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(50, 0), (51, 1), (52, 2)]
    assert leaks.clean_documents(table(spark, docs), items).count() == len(odd)


def test_url_model_on_held_out_hosts(spark):
    r = random.Random(4)
    bad = [(f"http://{r.choice(['casino', 'bets'])}-{r.choice('abc')}{k}.win-{k % 7}.com/x?{'&'.join(f'p{i}={r.random()}' for i in range(6))}", 1) for k in range(300)]
    good = [(f"https://{prose(1, k)}.example.org/{prose(1, 999 + k)}/{k}", 0) for k in range(300)]
    rows = [(k, u, y, "h", "p") for k, (u, y) in enumerate(bad + good)]
    d = spark.createDataFrame(rows, "page_id long, url string, label int, host string, path string")
    model = urls.fit(d.where("page_id % 2 = 0"), trees=5)
    out = urls.judged(d.where("page_id % 2 = 1"), model, rules=())
    assert out.where((F.col("verdict") == "block") == (F.col("_c_label") == 1)).count() >= 0.95 * 300
    strange = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "x://"), (4, "a://B.NET?q"), (5, "a://ÄB.net/en"), (5, "a://ÄB.net/en")], "page_id long, url string")
    got = {r._c_page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(strange, model).collect()}
    assert got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None) and got[4][:3] == ("b.net", "", None) and got[5][0] == "Äb.net" and got[5][2] == "net/"
    none = urls.fit(strange.select("url", F.lit(None).cast("int").alias("label")))
    assert urls.judged(strange, none).count() == 6


def test_warc_round_trip(spark):
    big = "<p>" + prose(30_000, 9) + "</p>"
    rows = [(1, "http://a/ä b\n", "x", 1), (2, None, "x", 1), (2, None, "x", 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", big, 1), (None, "u", "x", 1), (None, "u", "only", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, last int")
    got = warc.read_back(warc.written(pages)).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    want = [(1, "revisit", 1, 2), (2, "response", 1, None), (2, "response", 1, None), (3, "revisit", 0, 4), (4, "response", 0, None), (5, "response", len(big), None), (None, "revisit", 1, 2), (None, "response", 4, None)]
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert next(bytes(r.payload).decode() for r in got if r.page_id == 5) == big
    assert warc.read_back(warc.written(pages.limit(0))).count() == 0


def test_zip64_directory(monkeypatch):
    """With its limits lowered, zipfile writes ZIP64 fields for members that the reader must follow."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(5):
            z.writestr(f"m{k}", bytes([k]) * 150)
    raw = out.getvalue()
    found = warc.members(io.BytesIO(raw), len(raw))
    assert [m.name for m in found] == [f"m{k}" for k in range(5)]
    assert all(raw[m.start : m.start + m.size] == bytes([k]) * 150 for k, m in enumerate(found))


def test_blocks():
    html = """<html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script><!-- x <p> --><nav><a href="a>b">Home</a></nav>
    <article class="Post main"><h1>A &amp; B&nbsp;C</h1><p>one <b>two<br>three<p>four   five</article><svg><text>no</text></svg>tail &lt;p&gt;"""
    assert [b.text for b in blocks_of(html)] == ["Home", "A & B C", "one two three", "four five", "tail <p>"]
    assert blocks_of(html)[1].path[-4:] == (".post", ".main", "h1") or ".post" in blocks_of(html)[1].path
    assert blocks_of("") == [] and blocks_of("<<<>>") != None  # noqa: E711


def test_labeller_gradient():
    """The gradient of one weight of each matrix against a difference quotient."""
    rng = np.random.default_rng(1)
    pages = [rng.standard_normal((n, 5)) for n in (4, 7)]
    labels = [(rng.random(len(p)) > 0.5).astype(float) for p in pages]

    m = BlockLabeller(5, 3)
    x, turn, real = m._padded(pages)
    y = np.zeros(real.shape)
    for k, marks in enumerate(labels):
        y[: len(marks), k] = marks

    def loss():
        p = 1 / (1 + np.exp(-m._forward(x, turn)[1].astype(float)))
        return -float(((y * np.log(p) + (1 - y) * np.log(1 - p)) * real).sum() / real.sum())

    for name, g in m.gradient(x, turn, real, y).items():
        w, at, step = m.w[name], tuple(0 for _ in g.shape), 1e-2
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        down = loss()
        w[at] += step
        assert abs((up - down) / (2 * step) - float(g[at])) < 2e-4, name


def test_labeller_on_held_out_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_text.fit_labeller(pages)
    rng = np.random.default_rng(77)
    spare = [prose(30, k) for k in range(200)]
    right = total = 0
    for k in range(150):
        made, marks = html_text.laid_out(rng, [prose(25, 1000 + 10 * k + j) for j in range(4)], spare)
        s = model.scores([vectors(made)])[0]
        right += int(((s >= 0.5) == np.array(marks, bool)).sum())
        total += len(marks)
    assert right >= 0.97 * total
    odd = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "plain", "t"), (3, "plain", "t")], "page_id long, html string, text string")
    out = html_text.extracted(odd, model, ["page_id", "text"]).collect()
    assert len(out) == 4 and all(r.text == "" for r in out if r._c_page_id < 3)
    assert html_text.fit_labeller(odd.limit(0)) is not None


def test_pipeline_stages_bear_odd_rows(spark, odd, tmp_path):
    d = table(spark, odd).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (d, d.limit(0)):
        out = rows
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, out, "/root/testdata/sf0.001")
        assert out.columns == [*d.columns, "shard", "slot"]
        assert out.count() >= 0
