"""Quality rules against brute force, and held-out accuracy of the trained operators."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelgrid.llm import cotraining, html_text, quality_rules, toxicity
from babelgrid.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"


# --- quality rules --------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", " \n\t\n", "a b c\x1cd", "# * x\n\nsame\nsame\nsame \n", "é𝄞 " * 9, "a b " * 30,
                                  "one two three four five six seven eight nine " * 2 + "end"])
def test_counts(text):
    assert quality_rules.counts(text) == plain_counts(text)


def test_random_counts():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "a b\n", "\n", "$", "  "]) for _ in range(rng.randint(0, 80)))
        assert quality_rules.counts(t) == plain_counts(t)


def test_rules(spark):
    rng = random.Random(3)

    def good(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))

    rows = [(n, good(rng.randint(30, 300)), rng.choice(["en", "en", None]), rng.choice(["s", "t", None]), True, "x") for n in range(700)]
    junk = [(1000 + n, " ".join(w + "%%%" for w in good(100).split()), "en", "s", False, "x") for n in range(40)]
    bad = [(2000, None, "en", "s", True, "x"), (2001, "", None, None, True, "x"), (2002, "few words", "en", "s", True, "x"),
           (2003, "again and again we say the same thing " * 30, "en", "s", True, "x"), (None, good(50), "new", "new", True, "x")]
    df = spark.createDataFrame(rows + junk + bad, "doc_id long, text string, lang string, source string, kept boolean, n_words string")
    got = {r.doc_id: r for r in quality_rules.quality(df.drop("kept", "n_words")).collect()}
    for k, t, *_ in rows + junk + bad:
        r = got[k]
        n, chars, sym, dup, rep = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
    assert all(got[k].kept for k, *_ in rows) and got[None].kept
    assert not any(got[k].kept for k, *_ in junk) and not any(got[k].kept for k in range(2000, 2004))
    out = quality_rules.keep_good(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {k for k, r in got.items() if r.kept}
    assert quality_rules.keep_good(df.where("false")).collect() == []
    few = quality_rules.quality(df.limit(5)).collect()
    assert all(r.distance2 is None for r in few)


# --- toxicity -------------------------------------------------------------------

def test_toxicity_held_out(spark):
    rng = random.Random(5)

    def text(toxic):
        w = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 80))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["you zwrgle", "Pfuxq", "xkwzy!"])
        return " ".join(w)

    rows = [(n, text(n % 4 == 0), int(n % 4 == 0)) for n in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = toxicity.train(df, labels.where("doc_id % 3 <> 1"))
    test = toxicity.score(df.where("doc_id % 3 = 1").drop("toxic"), model).collect()
    right = [r.predicted == (r.doc_id % 4 == 0) for r in test]
    assert sum(right) >= 0.97 * len(right)
    odd = spark.createDataFrame([(None, None, 1, 2), (1, "", 1, 2), (1, "a", 1, 2), (2, "Pfuxq " * 100_000, 1, 2)],
                                "doc_id long, text string, score int, predicted int")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and [r.predicted for r in got if r.doc_id == 2] == [1]
    flat = toxicity.train(df.where("false"), labels)
    assert {r.score for r in toxicity.score(odd, flat).collect()} == {0.5}
    assert toxicity.score(odd.where("false"), model).collect() == []


def test_pieces_see_the_same_features(monkeypatch):
    text = "Some words, and ümläute 𝄞 " * 40
    whole = set(toxicity.features(text).tolist())
    monkeypatch.setattr(toxicity, "_PIECE", 50)
    assert whole <= set(toxicity.features(text).tolist())


# --- co-training ----------------------------------------------------------------

def test_views_exchange_labels():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 160)
    u = rng.integers(0, 2, 2000)
    a = lambda y: np.c_[y + rng.normal(0, 0.25, len(y)), rng.normal(size=len(y))]
    m = lambda y: np.c_[2 * y + rng.normal(0, 0.5, len(y)), rng.normal(size=len(y))]
    model = cotraining.cotrain(a(y), m(y), y, a(u), m(u))
    assert len(model.pseudo) > 1 and all(n > 0 for n in model.pseudo[0])
    t = rng.integers(0, 2, 1000)
    pt, pm, p = model.score(a(t), m(t))
    right = [((x >= 0.5) == t).mean() for x in (pt, pm, p)]
    assert right[2] >= max(right[:2]) - 0.01 and right[2] > 0.95
    one = cotraining.cotrain(a(y)[:3], m(y)[:3], np.ones(3, int), a(u), m(u))
    assert set(one.score(a(t), m(t))[2]) == {one.score(a(t[:1]), m(t[:1]))[2][0]}


def test_the_best_of_all_unlabelled_rows_are_exchanged(spark, monkeypatch):
    n = 9000  # more than the 8,000 of a bounded pool
    kind = "case when id % 100 = 7 then 'rare' else 'usual' end"
    docs = spark.range(n).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), cast(1 + id % 97 as int)) as text",
                                     "'en' as lang", f"{kind} as source", "id as n_chars").repartition(7)
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 97 > 40 as int) as quality")
    seen = []

    def spy(lt, lm, y, best, rounds):
        t, m = (cotraining.View.fit(x, y.astype(float)) for x in (lt, lm))
        for _ in range(2):
            seen.append(best({"t": t, "m": m}, 30))
        return t, m

    monkeypatch.setattr(cotraining, "exchange", spy)
    t, m = cotraining.train(docs, labels)
    rows = [r for r in docs.collect() if r.doc_id >= 200]
    x = {"t": np.array([cotraining.content(r.text) for r in rows]),
         "m": np.array([cotraining.metadata(r.lang, r.source, r.n_chars) for r in rows])}
    for teacher, view, pupil in (("t", t, "m"), ("m", m, "t")):
        p = cotraining.sigmoid(view.odds(x[teacher]))
        given = [(r, k) for s in seen for r, k in zip(*s[pupil], strict=True)]
        for q, share, of in ((p, view.share, lambda k: k), (1 - p, 1 - view.share, lambda k: 1 - k)):
            want = np.sort(q[q > share])[::-1][:60]
            got = [(r, of(k)) for r, k in given if of(k) > share]
            assert len(got) == len(want) == 60
            assert np.allclose(sorted((k for _, k in got), reverse=True), want)  # the label is the probability
            sure = {x[pupil][i].tobytes(): q[i] for i in np.argsort(q)}
            if pupil == "m":  # its rows are told apart by their length
                assert np.allclose([sure[r.tobytes()] for r, _ in got], [k for _, k in got])


def test_a_weak_view_teaches_what_it_knows():
    """A view that never nears certainty still passes on rows of both classes, and does the other no harm."""
    rng = np.random.default_rng(6)
    y, u, t = ((rng.random(n) < 0.85).astype(int) for n in (600, 4000, 2000))
    strong = lambda y: np.c_[2 * y + rng.normal(0, 0.4, len(y)), rng.normal(size=len(y))]
    weak = lambda y: np.c_[0.5 * y + rng.normal(0, 1, len(y)), rng.normal(size=len(y))]
    ly, lw, tt, tw = strong(y), weak(y), strong(t), weak(t)
    alone = cotraining.cotrain(ly, lw, y, strong(u[:0]), weak(u[:0]))
    model = cotraining.cotrain(ly, lw, y, strong(u), weak(u))
    assert len(model.pseudo) == cotraining.ROUNDS and all(a > 0 and b > 0 for a, b in model.pseudo)
    right = [((m.score(tt, tw)[2] >= 0.5) == t).mean() for m in (alone, model)]
    assert right[1] >= right[0] - 0.005 and right[1] > 0.98


def test_estimates_settle_at_a_small_determinant(spark):
    """No concentration step on the whole group lowers the determinant found, and plain starts from random
    elemental subsets find none that is clearly less; ``kept`` follows from it."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1500):
        n = int(rng.integers(30, 400))
        odd = k % 9 == 0
        rows.append((k, "en", "s", n, int(n * (9 if odd else 5) + rng.normal(0, n * 0.3)), int(rng.poisson(n * (0.2 if odd else 0.01))),
                     int(rng.poisson(3 if odd else 0.2)), int(min(n // 4, rng.poisson(2)))))
    d = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    est, priors = quality_rules.estimates(d)
    est = {r.g: r for r in est.collect()}
    assert len(est) == 3
    prior = priors.first().prior
    x = np.array([[np.log((c + prior * 50) / (n + 50)), np.sqrt(s / (n + 50)), np.sqrt(u * 10 / (n + 50)), np.sqrt(p / (n + 50))]
                  for _, _, _, n, c, s, u, p in rows])

    def step(m, w, share=quality_rules.SUBSET):
        u = x - m
        d2 = np.einsum("ni,ij,nj->n", u, w, u)
        b = np.floor(np.log2(np.maximum(d2, 1e-9)) * 32)
        mine = x[b <= np.sort(b)[int(np.ceil(len(b) * share)) - 1]]
        c = np.cov(mine.T, bias=True)
        inv, logdet = quality_rules._invert(c)
        return mine.mean(axis=0), inv, logdet

    def settle(m, w):
        best = np.inf
        for _ in range(100):
            m, w, now = step(m, w)
            if abs(now - best) < 1e-9:
                break
            best = now
        return best
    r = next(r for g, r in est.items() if g.startswith("0"))
    w = np.zeros((4, 4))
    for i, j in quality_rules._PAIRS:
        w[i, j] = w[j, i] = r[f"w{i}{j}"]
    m = np.array([r[f"m{i}"] for i in range(4)])
    assert step(m, w)[2] >= r.logdet - 1e-3
    least = min(settle(x[pick].mean(axis=0), quality_rules._invert(np.cov(x[pick].T, bias=True))[0])
                for pick in (rng.choice(len(x), 10, replace=False) for _ in range(60)))
    assert r.logdet <= least + 0.02
    fitted = spark.createDataFrame(list(est.values()), spark.createDataFrame([], quality_rules._EST).schema)
    got = {r.doc_id: r for r in quality_rules.judge(d, fitted, priors).collect()}
    u = x - m
    d2 = np.einsum("ni,ij,nj->n", u, w, u) / r.scale
    for k, row in enumerate(rows):
        assert got[k].base_failed or (got[k].kept == (d2[k] <= quality_rules.CUT) and got[k].distance2 == pytest.approx(d2[k], rel=1e-6))
    assert sum(not got[k].kept for k in range(1500) if k % 9 == 0) > 100


def test_vectors_are_never_shuffled_by_group_alone(spark):
    """Without broadcasts a group's vectors are dealt by group and salt."""
    d = spark.range(300).selectExpr("'en' lang", "'s' source", "id + 30 n_words", "(id + 30) * (5 + id % 3) word_chars", "id % 4 n_symbols",
                                    "id % 2 n_dup_lines", "id % 5 n_repeat_words")
    p = d.selectExpr("'2' g", "cast(n_words as double) x0", "cast(n_symbols as double) x1", "0d x2", "0d x3", "1L n",
                     "cast(n_words % 16 as int) salt")
    est = quality_rules.estimates(d)[0]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality_rules._at(p, est).groupBy("g", "bin").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    assert len(dealt) >= 3 and all("salt" in x or "bin" in x for x in dealt)


def test_quality_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    model = cotraining.train(docs, labels.where("doc_id % 3 <> 1"))
    test = docs.join(labels.where("doc_id % 3 = 1").select("doc_id", "quality"), "doc_id")
    got = cotraining.score(test, model).collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(None, None, None, None, None, 3), (1, "", "en", "s", 0, 3)],
                                "doc_id long, text string, lang string, source string, n_chars long, score int")
    assert all(0 <= r.score <= 1 for r in cotraining.score(odd, model).collect())
    assert cotraining.score(docs.where("false"), model).collect() == []


# --- html -----------------------------------------------------------------------

def test_blocks():
    page = ("<!DOCTYPE html><title>t</title><script>var x='<p>no</p>'</script><nav><a href='x>y'>m</a></nav>"
            "<!-- <p>c</p> --><p>a &amp; b<br>c  d<p><b>open<li>x</ul><div class=\"Side-Bar ad\">1<span>2</span>3</div>tail <unclosed")
    got = [(b.text, b.path[-1] if b.path else None) for b in html_text.blocks(page)]
    assert [t for t, _ in got] == ["m", "a & b c d", "open", "x", "123", "tail"]
    assert got[4][1] == ".ad" and html_text.blocks(None) == [] and html_text.blocks("  ") == []


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.train(spark.read.parquet(f"{MID}/pages.parquet"))


def test_gradient_is_right():
    rng = np.random.default_rng(1)
    m = html_text.Labeller.new(5, rng)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, mask = rng.normal(size=(4, 3, 5)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float)
    y = rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        z = m.odds(x, mask)[0]
        return float(((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum())

    g = m.gradient(x, mask, y)
    for k in m.w:
        at = tuple(rng.integers(0, n) for n in m.w[k].shape)
        keep = m.w[k][at]
        m.w[k][at] = keep + 1e-3
        up = loss()
        m.w[k][at] = keep - 1e-3
        down = loss()
        m.w[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4, k


def test_unseen_layouts(labeller):
    rng = np.random.default_rng(77)
    main = [" ".join(f"word{rng.integers(500)}" for _ in range(rng.integers(8, 60))) + "." for _ in range(200)]
    wrong = n = 0
    for _ in range(150):
        found, y = html_text._marked(*html_text.compose(rng, main, ["All rights reserved", "Sign in", "Home"]))
        got = labeller.labels([found])[0]
        wrong += int((got != np.array(y, bool)).sum())
        n += len(y)
    assert wrong <= 0.03 * n


def test_given_pages(spark, small_dir):
    import html
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    right = 0
    for r in QUERIES["op10_html_text"](spark, small_dir).collect():
        a = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?p>|</?h1>", a)]
        assert r.n_chars == len(r.text)
        right += r.text == "\n\n".join(p for p in parts if p)
    assert right >= 0.98 * len(pages)


def test_odd_pages(spark, labeller):
    df = spark.createDataFrame([(1, None, "u", "t"), (2, "", "u", "t"), (None, "<article><p>A plain text of some words.</p>", "u", "t"),
                                (3, "<p>" + "x < y & z > w <b" * 20_000, "u", "t")], "page_id long, html string, url string, text string")
    got = {r.page_id: r for r in html_text.extract(df, labeller).collect()}
    assert len(got) == 4 and got[1].text == got[2].text == "" and got[None].text == "A plain text of some words."
    assert html_text.extract(df.where("false"), labeller).collect() == []


def test_parser_is_linear():
    """Deep and unclosed markup of a megabyte takes about as long as flat markup."""
    import time
    flat = "<div><p>x</p></div>" * 55_000
    t0 = time.time()
    assert len(html_text.blocks(flat)) == 55_000
    base = time.time() - t0
    for page, n in (("<div>x" * 170_000, 170_000), ("<b>x<i>y</u>" * 87_000, 1), ("<ul><li>x" * 110_000, 110_000),
                    ("<table><tr><td>x" * 65_000, 65_000), ("<p><a href=x>y" * 75_000, 75_000), ("<li>x" * 200_000, 200_000)):
        t0 = time.time()
        assert len(html_text.blocks(page)) == n
        assert time.time() - t0 < 8 * base + 2, page[:20]


def test_paths_of_open_elements():
    got = html_text.blocks("<div class='a b'>1<p>2<p id=c>3<ul><li>4<li>5</ul></div>6<table><tr><td>7<td>8<tr><td>9</table>")
    assert [(b.text, " ".join(b.path)) for b in got] == [
        ("1", "div .a .b"), ("2", "div .a .b p"), ("3", "div .a .b p .c"), ("4", "div .a .b ul li"), ("5", "div .a .b ul li"),
        ("6", ""), ("7", "table tr td"), ("8", "table tr td"), ("9", "table tr td")]
    for b in got:
        row = np.zeros(html_text.PATH_DIM)
        for w in set(b.path):
            row[html_text._bucket(w, html_text.PATH_DIM)] += 1
        assert (row == b.vector).all()


def test_long_pages_go_in_chunks(labeller):
    page = html_text.blocks("<nav><a href=x>Home</a></nav><article>" + "".join(f"<p>Line {k} of it, said twice.</p>" for k in range(300))
                            + "</article><footer>Bye</footer>")
    x, mask = html_text._pad([html_text.vectors(page)])
    whole, _ = labeller.odds(x, mask)
    assert np.allclose(whole[:, 0], labeller.long_odds(page, 37), atol=1e-3)


def test_all_words_of_a_block_count():
    one, two = html_text.blocks("<p>" + "a " * 300 + "b</p>"), html_text.blocks("<p>" + "a " * 300 + "c</p>")
    assert (html_text.vectors(one) != html_text.vectors(two)).any()
