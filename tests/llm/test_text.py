import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tidelog.llm import chat, html_extract, licenses, packing, quality, url_filter

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="home form">
<header><h2>Site</h2></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<article class="post"><h1>Head &amp; line</h1><p>First <b>pa</b>ra<br>graph.<p>Second&nbsp;&lt;x&gt;<script>var t="</p>";</script>
<aside>Side</aside><div class="ad">Buy</div><form>Name</form><div id="comments"><p>Nice!</p></div><!-- no --><pre>a
  b</pre></article><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    lines = html_extract.blocks(PAGE)
    assert [x for x, m in lines if m] == ["Head & line", "First para graph.", "Second <x>", "a b"]
    assert all(m for _, m in lines)
    assert html_extract.blocks("") == [] and html_extract.blocks("a < b & c") == [("a < b & c", False)]
    assert html_extract.blocks('<p class="notice">x<p>y') == [("y", False)]


def lcs_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence():
    rnd = random.Random(1)
    assert html_extract.shared_lines(["x", "A", "x", "B"], ["A", "x", "B"]) == {1, 2, 3}
    for n in range(900):
        a, b = ([str(rnd.randrange(2 + n % 9)) for _ in range(rnd.randint(0, 14))] for _ in (0, 1))
        for states in (1 << 20, 1, 200):  # all states kept, or some made again
            got = sorted(html_extract.shared_lines(a, b, states))
            assert len(got) == lcs_length(a, b), (a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in got)


def test_pages_that_repeat_one_line_are_aligned_quickly():
    import time

    began = time.perf_counter()
    a, b = ["same"] * 20_000 + ["end"], ["start"] + ["same", "other"] * 10_000
    assert len(html_extract.shared_lines(a, b)) == 10_000
    a, b = [f"{i % 7}" for i in range(20_000)], [f"{i * i % 7}" for i in range(15_000)]
    assert len(html_extract.shared_lines(a, b)) > 7_000
    assert time.perf_counter() - began < 30


def test_names_of_classes():
    article = lambda inner, names="post related": f'<body><div class="menu">M</div><article class="{names}">{inner}</article></body>'
    kept = lambda page: [x for x, m in html_extract.blocks(page) if m]
    assert kept(article("<p>text</p>")) == ["text"]
    assert kept(article('<div id="search-engines"><p>on engines</p></div><div class="search-box">Find</div><p class="share-price">up</p>')) == ["on engines", "up"]
    assert kept(article('<header class="x"><h1>Head</h1><p>by me</p><nav>n</nav><h2>Sub</h2></header><p>text</p>')) == ["Head", "Sub", "text"]
    assert kept(article('<p>text</p><article class="related">other</article><div class="related-posts">o</div><div class="comment-list">c</div>')) == ["text"]
    assert kept(article("<header><h1>Head<p>x</article><p>after")) == ["Head", "x"]  # a heading ends at its end tag


def test_differencing_against_brute_force(spark):
    """Open pages of one host of 1,000: each meets the page of the longest common path, and loses what both have in order."""
    import os.path

    rnd = random.Random(7)
    pages = {}
    for i in range(1000):
        section = rnd.randrange(30)
        lines = [f"site line {k}" for k in range(4) if rnd.random() < 0.8] + [f"section {section} line {rnd.randrange(3)}" for _ in range(3)]
        lines += [f"page {i} says {k} at some length, so that it isn't outweighed by what is shared" for k in range(6)] + ["again"] * rnd.randrange(3)
        rnd.shuffle(lines)
        pages[f"/{section:02}/{rnd.randrange(10**6):06}-{i}"] = (i, lines)
    order = sorted(pages)
    want = {}
    for k, path in enumerate(order):
        near = [order[m] for m in (k - 1, k + 1) if 0 <= m < len(order)]
        other = max(near, key=lambda x: len(os.path.commonprefix([x, path])))  # the one before in a tie
        assert len(os.path.commonprefix([other, path])) == max(len(os.path.commonprefix([x, path])) for x in order if x != path)
        i, lines = pages[path]
        shared = html_extract.shared_lines(lines, pages[other][1])
        assert len(shared) == lcs_length(lines, pages[other][1])
        want[i] = "\n".join(x for n, x in enumerate(lines) if n not in shared)
    rows = [(i, f"http://one/{p[1:]}", "".join(f"<div>{x}</div>" for x in lines)) for p, (i, lines) in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == want and sum(len(x.split("\n")) for x in want.values()) < sum(len(x) for _, x in pages.values()) - 1000


def test_differencing_deletes_what_neighbours_share(spark):
    page = lambda body: f"<div>Our shop</div><div>{body}</div><div>Call us</div>"
    rows = [(1, "http://h/a/1", page("an article about one thing, long enough")), (2, "http://h/a/2", page("another text on something else, long too")), (3, "http://g/a", page("alone")), (4, None, None), (5, "x", "<p>t"), (6, "http://k/1", page("copy")), (7, "http://k/2", page("copy"))]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, host int, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()}
    assert got[1][0] == "an article about one thing, long enough" and got[2][0] == "another text on something else, long too"
    assert got[3][0] == "Our shop\nalone\nCall us" and got[4] == ("", 0) and got[5] == ("t", 1)
    assert got[6][0] == got[7][0] == "Our shop\ncopy\nCall us"
    assert html_extract.extract(df.limit(0)).count() == 0
    cut = {r["page_id"]: r["text"] for r in html_extract.extract(df, cell=1).collect()}
    assert len(cut) == len(rows)


def test_a_short_article_loses_the_site_text_that_outweighs_it(spark):
    site = "".join(f"<div>menu entry or notice number {i} of this site</div>" for i in range(9))
    long = "".join(f"<div>sentence {i} of an article that two pages carry</div>" for i in range(20))
    page = lambda body: f"{site}{body}<div>Call us</div>"
    rows = [(i, f"http://h/a/{i}", page(f"<div>short text {i}</div>")) for i in range(1, 4)] + [(11, "http://k/1", page(long)), (12, "http://k/2", page(long)), (13, "http://k/3", page("<div>other</div>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert [got[i] for i in (1, 2, 3, 13)] == ["short text 1", "short text 2", "short text 3", "other"]
    assert got[12].split("\n") == [f"sentence {i} of an article that two pages carry" for i in range(20)]


def test_pages_of_a_large_host_meet_their_true_neighbours(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        section, site = rnd.randrange(40), rnd.choice(["big", "big", "big", "small"])
        rows.append((i, f"http://{site}/{section:02}/{rnd.randrange(1000)}", f"<div>template of section {section}</div><div>an article of its own, number {i}, long enough to outweigh it</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, cut, cuts = ({r["page_id"]: r["text"] for r in html_extract.extract(df, cell=n).collect()} for n in (1000, 7, 1))
    assert cut == whole == cuts and len(whole) == 300
    alone = Counter(r[1].rsplit("/", 1)[0] for r in rows)
    assert all(len(whole[i].split("\n")) == (2 if alone[u.rsplit("/", 1)[0]] == 1 else 1) for i, u, _ in rows)


def test_url_rules(spark):
    urls = {"http://A.Net/x": ("a.net", "/x", "net/", "block"), "https://b.example.net/en/1?q": ("b.example.net", "/en/1", "example.net/en/", "allow"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://example.com/de/y#z": ("example.com", "/de/y", "example.com/de/", "block"), "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://q.org?a=/fr/": ("q.org", "", None, "allow")}
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, None).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.judge(df.limit(0), None).count() == 0


def test_reputation_blocks_only_what_is_surely_bad(spark):
    from pyspark.sql import functions as F

    rows = [(f"http://bad.spam.com/{i}", True) for i in range(60)] + [(f"http://g{i % 20}.fine{i % 7}.com/{i}", i % 40 == 0) for i in range(600)] + [("http://new.other.com/1", True), ("http://new2.com/", None)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(df, F.col("bad"), rules=()).collect()}
    assert got["bad.spam.com"] == "block" and got["new.other.com"] == "allow" and got["new2.com"] == "allow"
    assert {v for h, v in got.items() if h.startswith("g")} == {"allow"}


def test_posterior_against_its_closed_form(spark):
    counts = {"a.x.com": (5, 1), "b.x.com": (9, 9), "c.y.com": (20, 2), "d.co.uk": (4, 0), "e.f.co.uk": (3, 3), "": (2, 1), "new.x.com": (0, 0)}
    df = spark.createDataFrame([(h, n, b) for h, (n, b) in counts.items()], "host string, n long, bad long")
    got = {r["host"]: r for r in url_filter.reputation(df).collect()}

    def weight(members):
        chance = sum(p * (1 - p) for n, _, p in members if n)
        excess = sum(n * (b / n - p) ** 2 for n, b, p in members if n) - chance
        scale = sum(n * p * (1 - p) for n, _, p in members if n) - chance
        return min(max(2.0, 1 / max(excess / max(scale, 1e-9), 1e-6) - 1), 1000.0)

    ends = {"a.x.com": ("x.com", "com"), "b.x.com": ("x.com", "com"), "new.x.com": ("x.com", "com"), "c.y.com": ("y.com", "com"), "d.co.uk": ("d.co.uk", "co.uk"), "e.f.co.uk": ("f.co.uk", "co.uk"), "": ("", "")}
    total = lambda hosts: tuple(sum(counts[h][i] for h in hosts) for i in (0, 1))
    overall = (total(counts)[1] + 0.5) / (total(counts)[0] + 1)
    mean = {(): overall}
    for level in (1, 0):
        names = {ends[h][level:] for h in counts}
        sums = {x: total([h for h in counts if ends[h][level:] == x]) for x in names}
        w = weight([(*sums[x], mean[x[1:]]) for x in names])
        mean |= {x: (mean[x[1:]] * w + sums[x][1]) / (w + sums[x][0]) for x in names}
    w = weight([(*counts[h], mean[ends[h]]) for h in counts])
    for h, (n, b) in counts.items():
        assert abs(got[h]["alpha"] - (mean[ends[h]] * w + b)) < 1e-9 and abs(got[h]["beta"] - ((1 - mean[ends[h]]) * w + n - b)) < 1e-9


def test_labels_of_pages(spark):
    from pyspark.sql import functions as F

    rows = [("http://www.cheap-pills.com/", "<p>fine</p>", True), ("http://pillsbury.com/", "<p>some words here</p>", False), ("http://a.com/", "<p>a | b | c | d</p>", True), ("http://spam.com/", None, None), (None, "<script>|||||</script>ok words", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + rows[:1])], "page_id long, url string, html string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", url_filter.bad_page(F.col("url"), F.col("html"))).collect())
    assert url_filter.judge(df, url_filter.bad_page(F.col("url"), F.col("html"))).count() == len(rows) + 1


def brute_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_written_rules_against_brute_force():
    rnd = random.Random(7)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", " ", "  ", "\n", "é ", "#", "\x0b", "c d e "]) for _ in range(rnd.randint(0, 200)))
        assert quality.base(text.encode(), len(text))[:6] == brute_base(text)


def test_perplexity_bands_keep_clean_and_reject_junk(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice(["the", "an", "re", "ti", "on", "sh"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    clean = [" ".join(rnd.choice(words) for _ in range(120)) + "." for _ in range(150)]
    junk = [" ".join(w + rnd.choice(["%%%", "$$$"]) for w in clean[0].split()), clean[1].upper(), " | ".join(clean[2].split())]
    rows = [(i, t, "en", 1) for i, t in enumerate(clean + junk)] + [(900, None, "en", 1), (901, clean[3], None, 1), (901, clean[3], None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, low int")
    got = [(r["doc_id"], r["kept"]) for r in quality.quality(df).collect()]
    assert sorted(i for i, kept in got if not kept) == [150, 151, 152, 900]
    assert len(got) == len(rows) and quality.quality(df.limit(0)).count() == 0
    more = spark.createDataFrame([(1, junk[0], "en", 1), (None, junk[0], "en", 2), (None, clean[4], "en", 3)], df.schema)
    left = quality.keep_good(df.unionByName(more))
    assert left.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted([(False, i) for i in range(150)] + [(False, 901)] * 2 + [(True, 0)])


def plain_kneser_ney(texts, order):
    """Modified Kneser-Ney by dictionaries: the negative log probability of a text, byte by byte."""
    runs = Counter()
    for t in texts:
        data = b"\n" * (order - 1) + t.encode()
        runs.update(data[i : i + order] for i in range(len(data) - order + 1))
    levels = {order: runs}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(r[1:] for r in levels[k + 1])
    about = {}
    for k, counts in levels.items():
        t = Counter(counts.values())
        y = t[1] / max(1, t[1] + 2 * t[2])
        d = [min(float(i), max(0.05, i - (i + 1) * y * t[i + 1] / max(1, t[i]))) for i in (1, 2, 3)]
        less = lambda n, d=d: d[min(n, 3) - 1]
        total, back = Counter(), Counter()
        for r, n in counts.items():
            total[r[:-1]] += n
            back[r[:-1]] += less(n)
        about[k] = {r: (n - less(n)) / total[r[:-1]] for r, n in counts.items()}, {c: back[c] / total[c] for c in total}

    def chance(run):
        p = 1 / 256
        for k in range(1, order + 1):
            own = run[-k:]
            seen, weight = about[k]
            if own[:-1] in weight:
                p = seen.get(own, 0) + weight[own[:-1]] * p
        return p

    def score(text):
        data = b"\n" * (order - 1) + text.encode()
        return -sum(np.log(chance(data[i : i + order])) for i in range(len(data) - order + 1)) / len(text.encode())

    return score


def test_scores_are_those_of_a_plain_kneser_ney(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice(["the", "an", "ré", "ti", "on", "sh"]) for _ in range(rnd.randint(1, 4))) for _ in range(200)]
    texts = [" ".join(rnd.choice(words) for _ in range(90)) for _ in range(40)]
    odd = ["\U0001f600" * 80, "the"]  # too few words: they aren't references
    score = plain_kneser_ney(texts, quality.ORDER)
    df = spark.createDataFrame(list(enumerate(texts + texts[:5] + odd)), "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = {r["doc_id"]: r["score_milli"] for r in quality.quality(df).collect()}
    assert len(got) == 47
    for i, t in enumerate(texts + texts[:5] + odd):
        assert abs(got[i] - 1000 * score(t)) <= 1.01, (i, got[i], 1000 * score(t))


def test_the_lower_band_rejects_what_is_too_predictable(spark):
    rnd = random.Random(13)
    short = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 7))) for _ in range(400)]
    long = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(12)]
    clean = [" ".join(rnd.choice(long) if rnd.random() < 0.03 else rnd.choice(short) for _ in range(150)) for _ in range(150)]
    listed = " ".join(rnd.choice(long) for _ in range(60))  # a list of known names: no sentence, and no window often enough
    df = spark.createDataFrame(list(enumerate([*clean, listed])), "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert not got[150]["base_failed"] and not got[150]["kept"] and got[150]["score_milli"] < got[150]["low"]
    assert all(got[i]["kept"] for i in range(150))


def test_texts_above_a_piece_are_scored_whole(spark):
    rnd = random.Random(14)
    words = ["".join(rnd.choice(["the", "an", "re", "ti", "on", "sh"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(100)) for _ in range(30)] + [" ".join(rnd.choice(words) for _ in range(170_000))]
    assert len(texts[-1]) > quality._PIECE
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert got[30]["n_words"] == 170_000 and got[30]["word_chars"] == sum(map(len, texts[-1].split()))
    assert abs(got[30]["score_milli"] - 1000 * plain_kneser_ney(texts, quality.ORDER)(texts[-1][:20_000])) < 60


def test_copies_of_a_text_do_not_move_the_bands(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice(["the", "an", "re", "ti", "on", "sh"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    clean = [" ".join(rnd.choice(words) for _ in range(120)) + "." for _ in range(100)]
    junk = [" ".join(w + rnd.choice(["%%%", "$$$"]) for w in clean[0].split()), clean[1].upper(), " | ".join(clean[2].split())]
    once = list(enumerate(clean + junk))
    schema = "doc_id long, text string, lang string"

    def judged(rows):
        return {r["doc_id"]: (r["kept"], r["score_milli"], r["low"], r["high"]) for r in quality.quality(spark.createDataFrame([(*r, "en") for r in rows], schema)).collect()}

    want = judged(once)
    assert sorted(i for i, x in want.items() if not x[0]) == [100, 101, 102]
    for copies in (50, 400):  # a third of all rows, and four fifths
        got = judged(once + [(1000 + i, clean[7]) for i in range(copies)])
        assert {i: got[i] for i in want} == want and all(got[1000 + i][0] for i in range(copies))


@pytest.mark.parametrize("bits", [6, 8, 24])
def test_each_text_of_a_language_counts_once(spark, bits):
    rows = [(i % 40, f"text {i % 300}" if i % 7 else None, ("en", "de", None, "")[i % 4]) for i in range(1000)] + [(1, f"own {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = quality._distinct(docs, quality._copied(docs, "text", "lang", bits), "text", "lang", bits).collect()
    want = {(t and t.encode(), lang or "") for _, t, lang in rows}
    assert {(r["text"] and bytes(r["text"]), r["lang"]) for r in got} == want and len(got) == len(want)


def test_texts_without_copies_are_not_shuffled(spark, tmp_path):
    rnd = random.Random(12)
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) for _ in range(200)]
    path = f"{tmp_path}/docs.parquet"
    spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, *texts[:10]])], "doc_id long, text string, lang string").write.parquet(path)

    def shuffled():
        none, store = spark._jvm.java.util.ArrayList(), spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    # None of the texts is a reference, so all that is shuffled are keys and texts.
    quality.model(spark.read.parquet(path))
    assert sum(n for k, n in shuffled().items() if k not in before) < 1_000_000  # the texts have 4,200,000 bytes, those with copies 400,000


def test_unseen_runs_stay_unseen_in_a_varied_corpus(spark):
    rnd = random.Random(8)
    some = lambda: "".join(chr(rnd.choice([97 + rnd.randrange(26), 97 + rnd.randrange(26), 0x4E00 + rnd.randrange(20_000)])) for _ in range(6))
    rows = [(i, " ".join(some() for _ in range(400)), "en") for i in range(400)]
    tables = quality.model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    arrays = quality._arrays(tables, 0, 1)
    own = {k: len({t.encode()[i : i + k] for _, x, _ in rows for t in ["\n" * (k - 1) + x] for i in range(len(t.encode()) - k + 1)}) for k in (4, 5)}
    assert own[5] > 1_000_000
    for k, n in own.items():
        assert len(arrays["en", 2 * k][0]) == n  # no two runs share an entry
    known = arrays["en", 10][0]
    new = np.setdiff1d(np.random.default_rng(1).integers(0, 1 << 40, 200_000, dtype=np.uint64), known)
    assert not quality._found(arrays["en", 10], new)[0].any()


def test_shards_score_as_the_whole_model_does(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["the", "über", "文字", "ration", "a"]) + rnd.choice("xyz") for _ in range(80)) for _ in range(30)]
    rows = [(i, t, rnd.choice(["en", "de", None])) for i, t in enumerate(texts)] + [(3, texts[3], "en"), (3, texts[3], "en"), (90, "", "en"), (91, None, None), (92, "# " * 90, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scores = lambda most: sorted(tuple(r[c] or 0 for c in ("doc_id", "n_words", "kept", "score_milli")) + (r["lang"] or "",) for r in quality.quality(df, most=most).collect())
    whole, cut = scores(1 << 20), scores(1000)
    assert len(cut) == len(whole) == len(rows)
    for a, b in zip(whole, cut, strict=True):
        assert (*a[:3], a[4]) == (*b[:3], b[4]) and abs(a[3] - b[3]) <= 1


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "<\\/s> </s> <\\\\s>"), (3, 0, None, None), (3, 1, "we%0A\n[x", "[INST]a\nb"), (4, 0, "assistant", "<s>"), (4, 0, "assistant", "<s>"), (5, 0, "user", "<"), (5, 1, "assistant", "[/INST"), (6, None, "tool", "x" * 50_000), (6, 1, "user", "</s>" * 500)]


def test_chats_survive_the_round_trip(spark):
    df = spark.createDataFrame([(*c, "z") for c in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.collect()}
    for k in {c[0] for c in CHATS}:
        want = [(r or "", t or "") for _, _, r, t in sorted((c for c in CHATS if c[0] == k), key=lambda c: -1 if c[1] is None else c[1])]
        assert [(t["role"], t["text"]) for t in got[k]["turns"]] == want
    assert "[INST]" not in got[2]["formatted"].removeprefix("[INST]user\n") and got[2]["formatted"].count("</s>") == 1  # no forged marks
    assert not got[1]["escaped"] and got[2]["escaped"] and got[1]["formatted"] == "[INST]user\nhi[/INST]<s>yo</s>"
    for r in chat.digest(out).collect():
        said = [(c[2] or "", c[3] or "") for c in CHATS if c[0] == r["conv_id"]]
        loss = "".join(t for role, t in said if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_licenses(spark):
    long = licenses.PASSAGES[0][0]
    assert licenses.run_hash(["mit", "license"]) == spark.sql("SELECT xxhash64('mit', 'license')").first()[0]
    changed = long.replace("deal in", "deal freely in")
    texts = ["MIT license, mit License", "the General Public License v3", long, changed, "x " * 40 + long[: len(long) // 3], "", None, "mit", "license mit", "Apache-License!", "a mité license", "m\u0130t license", "general public \u0130icense MIT LICENSE", long.lower() + " \u212a"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(50, "mit license", "c"), (50, "mit license", "c"), (50, "gpl", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    at = lambda i: (got[i][0]["n_words"], got[i][0]["n_base"], got[i][0]["first_word"], got[i][0]["last_word"], got[i][0]["base_labels"])
    assert at(0) == (4, 2, 0, 2, "mit") and at(1) == (5, 1, 1, 1, "gpl") and at(9) == (2, 1, 0, 0, "apache")
    assert got[2][0]["labels"] == "mit-text" and got[3][0]["labels"] == "mit-text" and got[4][0]["labels"] == "" and got[2][0]["score"] == 1.0
    assert at(5) == at(6) == (0, 0, None, None, "") and at(7)[1] == at(8)[1] == at(10)[1] == 0
    assert sorted(r["n_base"] for r in got[50]) == [0, 1, 1]
    assert at(11) == (2, 0, None, None, "") and at(12)[1:] == (1, 3, 3, "mit") and at(13)[0] == at(2)[0] + 1 and got[13][0]["labels"] == "mit-text"
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_license_texts(spark):
    rnd, texts = random.Random(3), licenses.license_texts.WHOLE
    noise = lambda n: " ".join(rnd.choice(["one", "two", "three", "the", "of", "license"]) for _ in range(n))
    rows = [(i, f"{noise(50)} {t.upper() if i % 2 else t} {noise(50)}") for i, (t, _) in enumerate(texts)]
    words = texts[0][0].split()
    rows += [(50, " ".join(w for i, w in enumerate(words) if i % 40)), (51, noise(5000)), (52, " ".join(rnd.sample(words, len(words))))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, label) in enumerate(texts):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
        span = next(s for s in got[i]["spans"] if s["label"] == label)
        assert span["first"] == 50 and span["last"] == 50 + len(licenses.words_of(t)) - 3
    assert "bsd-3-clause-full" not in got[1]["labels"].split(",")
    assert "mit-full" in got[50]["labels"] and 0.8 < got[50]["score"] < 1.0
    assert got[51]["labels"] == got[52]["labels"] == ""


def test_a_long_text_takes_linear_time(spark):
    import time

    took = []
    for n in (20_000, 160_000):
        df = spark.createDataFrame([(1, "some words of text, mit license " * (n // 6))], "doc_id long, text string")
        licenses.scan(df).collect()
        began = time.perf_counter()
        row = licenses.scan(df).collect()[0]
        took.append(time.perf_counter() - began)
        assert row["n_words"] == n // 6 * 6 and row["n_base"] == n // 6
    assert took[1] < 8 * took[0] + 5


def checked_bins(sizes, packed, lengths):
    bins, places, final, opened = packed
    spans = {}
    for s, b, p in zip(sizes, bins, places, strict=True):
        spans.setdefault(b, []).append((p, p + s))
    assert sorted(spans) == list(range(len(final)))
    for b, own in spans.items():
        own.sort()
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
        assert final[b] == min(n for n in lengths if n >= own[-1][1]) and opened[b] >= final[b]
    return spans


def smallest_fit(sizes, lengths):
    """Best fit with the smallest length that holds a piece: what a joint choice must not be worse than."""
    bins = []
    for s in sorted(sizes, reverse=True):
        open_bins = [b for b in bins if b[0] - b[1] >= s]
        if open_bins:
            min(open_bins, key=lambda b: b[0] - b[1])[1] += s
        else:
            bins.append([min(n for n in lengths if n >= s), s])
    return sum(packing.cost(min(n for n in lengths if n >= used)) for _, used in bins)


def test_packing_chooses_lengths_jointly():
    rnd = random.Random(1)
    shares = []
    for draw in (lambda: rnd.randint(1, 8192), lambda: min(8192, int(rnd.lognormvariate(6.5, 1)) + 1), lambda: rnd.choice([600, 700, 512, 1500]), lambda: 7):
        sizes = [draw() for _ in range(1500)]
        packed = packing.pack(sizes)
        spans = checked_bins(sizes, packed, packing.LENGTHS)
        shares.append(sum(map(packing.cost, packed[2])) / smallest_fit(sizes, packing.LENGTHS))
        assert shares[-1] <= 1.002
        larger = sum(packed[3][b] > min(n for n in packing.LENGTHS if n >= max(y - x for x, y in own)) for b, own in spans.items())
        if len(shares) == 3:
            assert larger > 200 and shares[-1] < 0.85  # two of 600 to 700 in 2048, not one in 1024
    assert any(a > b for a, b in zip(packed[3], packed[2], strict=True))  # the last bin is downsized
    for bad in (9000, 0):
        with pytest.raises(ValueError):
            packing.pack([bad])
    assert packing.pack([]) == ([], [], [], [])


def test_packing_against_the_optimum_of_tiny_inputs():
    rnd, lengths = random.Random(2), (4, 8, 16)

    def partitions(rest):
        if not rest:
            yield []
            return
        for mask in range(1 << len(rest) - 1):
            own = [rest[0]] + [x for i, x in enumerate(rest[1:]) if mask >> i & 1]
            for more in partitions([x for i, x in enumerate(rest[1:]) if not mask >> i & 1]):
                yield [own, *more]

    cost, found = lambda n: packing.cost(n, 1, 64), []
    for _ in range(150):
        sizes = [rnd.randint(1, 12) for _ in range(6)]
        packed = packing.pack(sizes, lengths, 1, 64)
        checked_bins(sizes, packed, lengths)
        best = min(sum(cost(min(n for n in lengths if n >= sum(b))) for b in p) for p in partitions(sizes) if max(map(sum, p)) <= 16)
        found.append(sum(map(cost, packed[2])) / best)
    assert min(found) > 0.999 and max(found) < 1.35 and sum(found) / len(found) < 1.04


def test_packing_of_documents(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [(1, "hello " * 900), (2, None), (2, ""), (2, ""), (None, "é"), (None, "one more text, <|endoftext|> in it"), *[(9, "a copy")] * 20]
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in texts]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, bin_id int")
    for group, at_least in ((1 << 20, 1), (200, 2)):
        got = packing.pack_documents(df, path, lengths=(64, 128, 256), group=group).collect()
        assert len({r["bin_id"] >> 32 for r in got}) >= at_least and len({r["bin_id"] for r in got}) == len(got)
        pieces = Counter()
        for r in got:
            assert sum(r["lengths"]) == r["n_tokens"] == len(r["ids"]) <= r["bin_length"] <= r["opened_length"]
            for d, k, at, n in zip(r["doc_ids"], r["pieces"], r["places"], r["lengths"], strict=True):
                pieces[d, k, tuple(r["ids"][at : at + n])] += 1
        want = Counter((d, k, tuple(x[256 * k : 256 * (k + 1)])) for (d, _), x in zip(texts, ids, strict=True) for k in range(-(-len(x) // 256)))
        assert pieces == want
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    words = ["".join(rnd.choice(["the", "an", "re", "ti", "on", "sh"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(200)) for _ in range(60)]
    texts += [texts[0], texts[0].upper()[:1] + texts[0][1:], texts[1] + " end", "short", " ".join(w + "%%%" for w in texts[2].split())]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in df.collect()})
    every = set(range(len(texts)))
    assert left[0] == every - {63, 64} and left[1] == left[0] - {0, 60} and left[2] <= left[1] and len(left[1] - left[2]) <= 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(d for r in out for d in r["doc_ids"]) == Counter(left[2])
