import hashlib
import re
import time
import unicodedata
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import exact, html, pii, urls


def folded(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())).strip()


def test_fingerprints_equal_brute_force(spark, odd_docs, documents):
    docs = documents.select("doc_id", "text").unionByName(odd_docs.where("doc_id is not null and doc_id != 2").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = {r["doc_id"]: r for r in exact.fingerprints(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    groups = {}
    for k, (i, text) in enumerate(rows):
        after, half, r = rows[(k + 1) % len(rows)][1], len(text) // 2, got[i]
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(folded(text) == folded(edited)) and r["near_next"] == float(folded(text) == folded(after))
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            groups.setdefault(f, set()).add(folded(t))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({t for g in groups.values() for t in g})


def test_ranges_and_edges(spark, monkeypatch, odd_docs, no_docs):
    monkeypatch.setattr(exact, "RANGE_ROWS", 2)
    texts = [(i, f"text {i} " * (i % 5)) for i in range(23)]
    got = {r["doc_id"]: r["edited_sha256"] for r in exact.fingerprints(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    for i, t in texts:
        after, half = texts[i - 1][1], len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert exact.fingerprints(no_docs).count() == 0
    assert exact.fingerprints(odd_docs.where("doc_id = 1")).first()["near_next"] == 1.0
    assert exact.fingerprints(odd_docs).count() == odd_docs.count()


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    def weak(canon):
        return F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(2).cast("bigint").alias("b"), F.xxhash64(canon).alias("c"))

    monkeypatch.setattr(exact, "digest", weak)
    rows = exact.fingerprints(spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA")], "doc_id bigint, text string")).collect()
    f = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert f[1] == f[3] != f[2]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    d = [int(c) for c in v if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


HARD = [
    "a@b.c_x@d.e a@b a@@b.c x@y.z@w.v %+@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 999999999999999999999.1.1.1 1..2.3.4",
    "4111-1111 1111 1111 2 4111111111111111 4111  1111", "+1 (555) 010-9999) +12 +123456789012345678 ++49 30 123456", "😀+49.30.123456 é@b.c 😀@b.cd", "9" * 5000 + "@x.y", "", "phone 555-123-4567 and joe [at] site [dot] com",
    "4451718024887799 27.65.93.188 card 4111111111111111 7",
]


def test_base_spans_equal_plain_patterns(spark, documents, odd_docs):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(HARD, 5000)), "doc_id bigint, text string")).unionByName(odd_docs.select((F.col("doc_id") + 9000).alias("doc_id"), "text"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    rows = pii.find(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (r["doc_id"], want, r["spans"])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert set(filter(None, said.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_needs_lose_no_match(spark, documents):
    odd = ["Call (555) 123-4567 now", "(020) 7946-0958", "tel (02).7946 0958", "fax 020-7946-0958", *HARD, "joe(at)site.com", "4111-1111-1111-1111", "1111222233334444"]
    docs = documents.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for shape, patterns in (("base", pii.BASE), ("loose", pii.LOOSE)):
        for kind, p in patterns.items():
            found = docs.select(pii._found("text", p, pii.NEEDS[shape][kind]).alias("a"), pii._found("text", p, "").alias("b"))
            if (shape, kind) == ("base", "card"):  # runs under 12 digits never pass
                found = found.select(*[F.filter(c, lambda x: F.length(F.regexp_replace(x["val"], "[^0-9]", "")) >= 12).alias(c) for c in "ab"])
            assert found.where("b != a").count() == 0 and found.where("size(b) > 0").count(), (shape, kind)
    row = pii.find(spark.createDataFrame([(1, odd[0]), (2, odd[1])], "doc_id bigint, text string")).collect()
    assert sorted(r["spans"] for r in row) == ["phone:0:15", "phone:5:19"]


def test_label_model_learns_reliabilities():
    counts = [(0, (1, 1, 1, 0, 1, 1), 50), (0, (1, 1, 0, 0, 1, 1), 80), (0, (0, -1, 0, -1, -1, -1), 60), (3, (0, 0, 0, -1, 1, 1), 20), (3, (0, 0, 1, 0, 1, 1), 10)]
    post = pii.reliabilities(counts)
    assert post[0] > 0.9 and post[2] < 0.1
    assert pii.train([]) and pii.reliabilities([]) == []


def test_redaction(odd_docs, no_docs):
    out = {r["doc_id"]: r["text"] for r in pii.redact(odd_docs).collect()}
    assert out[11] == "mail [EMAIL], host [IP] or 1.2.3.256, card [CARD] call [PHONE]." and out[4] is None and out[5] == ""
    assert pii.redact(odd_docs).columns == odd_docs.columns and pii.redact(no_docs).count() == 0


def test_many_matches_in_one_text(spark):
    """Work is linear: 32,000 spans of all kinds and proposals between them, in one text."""
    piece = "mail a%d@b.example.com or 10.0.%d.7, call (555) 123-4567 or +1 555 010 9999; "
    text = "".join(piece % (i, i % 250) for i in range(8000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    pii.find(df.limit(0)).collect()
    began = time.perf_counter()
    row = pii.find(df).first()
    assert (row["n_email"], row["n_ip"], row["n_phone"]) == (8000, 8000, 8000)
    assert pii.annotate(df).select(F.size("spans")).first()[0] == 32_000
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
    out, at = [], 0
    for k, a, b in (x.split(":") for x in row["spans"].split(",")):
        out += [text[at : int(a)], f"[{k.upper()}]"]
        at = int(b)
    assert pii.redact(df).first()["text"] == "".join(out) + text[at:]
    assert time.perf_counter() - began < 60


def test_overlapping_spans(spark):
    """Proposals that a strict span overlaps go; of overlapping strict spans the first stays in the text."""
    texts = ["+49 4111 1111 1111 1111 x", "4111 1111 1111 1111@b.example.com", "1.2.3.4@x.example.com", "555-123-4567 +1 555-123-4567 555-123-4567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    said = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    for i, text in enumerate(texts):
        base = base_spans(text)
        found = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in filter(None, said[i].split(",")))]
        assert set(base) <= set(found)
        for k, a, b in set(found) - set(base):
            assert not [1 for _, c, d in base if c < b and d > a], (text, found)
    assert len(said[3].split(",")) == 3


PAGES = [
    (1, "http://x", "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li><li>News</li></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p>First\n  <b>bold</b> line.<p>Second &eacute;.<br>more</article><div id='comments'><p>nice post</p></div><footer>&copy; me</footer>"),
    (2, None, None),
    (3, "u", ""),
    (4, "u", "<script>only()</script>"),
    (5, "u", "<div class=menu>a</div><div>" + "words and more words " * 20 + "</div><div>" + "the story goes on " * 20 + "</div><form><input>Name</form><div class='footer'>end</div>"),
]


def test_main_text(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("text", F.lit(0))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[1]["text"] == "A & B\nFirst bold line.\nSecond é. more"
    assert [got[i]["text"] for i in (2, 3, 4)] == [""] * 3
    assert got[5]["text"] == ("words and more words " * 20).strip() + "\n" + ("the story goes on " * 20).strip()
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.extract(df.where("false")).count() == 0


def test_main_text_is_whole_without_article():
    long, other = "the story goes on " * 16, "words and more words " * 13
    p = lambda t, n: [f"{t.strip()} {k}" for k in range(n)]
    page = lambda *lines: "<html><body><div class='nav'>Home</div>" + "".join(x if x[0] == "<" else f"<p>{x}</p>" for x in lines) + "<div class='site-footer'>end</div></body></html>"
    advert = ["<div class='ad'><p>buy</p><p>now</p><p>here</p></div>"]
    short, tail = [f"a short item {k}" for k in range(5)], [f"a line of some thirty letters {k}" for k in range(8)]
    for middle in (advert, short):
        lines = ["A title", *p(long, 6), *middle, *p(other, 6)]
        assert html.main_text(page(*lines)).split("\n") == [x for x in lines if x[0] != "<"]
    assert html.main_text(page(*p(long, 3), *tail)).split("\n") == p(long, 3) + tail


def test_names_of_whole_pages_are_no_boilerplate():
    story = "the story goes on " * 20
    for name in ("no-sidebar", "has-header-image", "with-nav", "sidebar", "page header"):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", f"<p>{story}</p>"):
            assert html.main_text(f"<html class='{name}'><body class='{name}'>{inner}<div class='footer'>end</div></body></html>") == story.strip()
        assert html.main_text(f"<body><div id='{name}'><article>{story}</article></div><nav>x</nav></body>") == story.strip()
    for name in ("no-sidebar", "has-header-image", "with-nav"):
        assert html.main_text(f"<div class='{name}'><p>{story}</p></div>") == story.strip()
    assert html.main_text(f"<body><form><nav>menu</nav><p>{story}</p></form></body>") == story.strip()
    assert html.main_text(f"<article>{story}</article><div class='related'><article>teaser</article></div><aside><article>other</article></aside>") == story.strip()
    for name in ("site-footer", "cookie-notice", "ad ad-300x250", "main-nav", "comment-list"):
        assert html.main_text(f"<p>{story}</p><div class='{name}'>{story}</div>") == story.strip()


def plain_region(lengths, articles, window=3):
    """The definition, line by line: positions in steps, each hill walked, no sums kept."""
    places, where = [], []
    for k, n in enumerate(lengths):
        if k and articles[k] != articles[k - 1]:
            places += [(0, 0)] * window
        where.append(len(places))
        places.append((n, articles[k]))
    block = lambda i: sum(places[j][0] for j in range(i - window + 1, i + 1) if 0 <= j < len(places))
    hills, now = [], None
    for i in range(len(places) + window):
        if block(i) > 0:
            now = now or [i, i, 0, 0, places[i][1] if i < len(places) else 0]
            now[1], now[2] = i, max(now[2], block(i))
            now[3] += places[i][0] if i < len(places) else 0
        elif now:
            hills.append(now)
            now = None
    if not hills:
        return [False] * len(lengths)
    level = min(120, max(h[2] for h in hills) // 4)
    told = max([h[3] for h in hills if h[4]], default=0)
    good = [h for h in hills if h[4] or (h[2] >= level and h[3] >= told)]
    if not told:
        good = [[good[0][0], good[-1][1]]]
    return [n > 0 and any(h[0] <= i <= h[1] for h in good) for i, n in zip(where, lengths, strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 3, 20, 45, 130, 400]), st.sampled_from([0, 0, 0, 1, 1, 2])), max_size=30))
def test_region_equals_definition(lines):
    lengths, articles = [n for n, _ in lines], [a for _, a in lines]
    assert html.region(lengths, articles) == plain_region(lengths, articles)


class PlainPage(HTMLParser):
    """Lines of the tables' pages by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.open, self.lines, self.text = [], [], ""
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if text := " ".join(self.text.split()):
            names = [t for t, _ in self.open]
            boiler = any(t in ("nav", "footer", "aside", "header", "form") or c in ("ad", "sidebar", "comments") for t, c in self.open)
            self.lines.append((text, boiler, int("article" in names)))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        if tag in ("p", "div", "ul", "li", "nav", "article", "footer", "h1", "h2", "aside", "header", "form", "body", "table", "tr", "td", "blockquote", "section"):
            self.end()
        if tag == "p" and any(t == "p" for t, _ in self.open):
            while self.open.pop()[0] != "p":
                pass
        if tag not in ("br", "meta", "img", "input", "link", "hr"):
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in ("p", "div", "ul", "li", "nav", "article", "footer", "h1", "h2", "aside", "header", "form", "body", "table", "tr", "td", "blockquote", "section"):
            self.end()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in ("script", "style", "title", "head") for t, _ in self.open):
            self.text += data


def test_pages_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(200)
    got = {r["page_id"]: r["text"] for r in html.extract(pages.unionByName(pages.limit(3))).collect()}
    for r in pages.collect():
        lines = PlainPage(r["html"]).lines
        kept = plain_region([0 if b else len(t) for t, b, _ in lines], [a for *_, a in lines])
        assert got[r["page_id"]] == "\n".join(t for (t, *_), k in zip(lines, kept, strict=True) if k)
    assert len(got) == 200


def test_markup_that_is_odd():
    story = "the story goes on " * 20
    p = lambda t: f"<p>{t}</p>"
    lines = lambda page: [x[:5].strip() for x in html.main_text(page).split("\n")]
    assert lines(f"<body class='has-sidebar'>{p('one ' + story)}</body>") == ["one t"]
    assert lines(f"<body>{p('one ' + story)}<article class='teaser'><p>two teaser</p></article>{p('three ' + story)}</body>") == ["one t", "two t", "three"]
    assert lines(f"<article>{p('one ' + story)}<svg/>{p('two ' + story)}<iframe src=x>{p('three ' + story)}<svg><path/></svg></article>") == ["one t", "two t", "three"]
    assert lines(f"<article><header><h1>Title</h1></header><p class='related-work'>rel {story}</p><p>x</p></article><p>after</p>") == ["Title", "rel t", "x"]
    assert lines(f"<script>var a = 1; <p>{story}</p><style>p{{}}<div>more {story}</div><!-- open <div>last {story}</div>") == ["the s", "more", "last"]
    assert html.main_text("<title>x" + p(story)) == story.strip()
    for piece, most in (("<svg>", 0), ("<!--", 0), ("<b><p>", 0), ("<div>", 0), ("</p>", 0), ("<script>", 0), ("<p ", 3), ("<a href='", 9)):
        began = time.perf_counter()
        assert len(html.main_text(piece * 40_000)) <= most * 40_000
        assert time.perf_counter() - began < 5
    page = "<article>" + p(story) * 5000 + "</article>"
    assert html.main_text(page) == "\n".join([story.strip()] * 5000)


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    name, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, name, verdict


def test_rules_and_verdicts(spark):
    given = [None, "", "no scheme", "HTTP://A.Example.COM/en/7?x=1", "https://example.com/en/9", "https://xexample.com/en/9", "http://a.net/de/1", "http://example.net/de/80#f", "http://q.org/es/", "http://org/es/1", "x://y://z/w", "https://net/fr/", "http://É.com/EN/", "http://h?q=/en/", "a\nb://c.com/en/\n2"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string").withColumn("host", F.lit("clash")).unionByName(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id + 100 as page_id", "url", "'x' as host"))
    rows = urls.judge(df).collect()
    texts = {r["page_id"]: r["url"] for r in df.collect()}
    for r in rows:
        host, path, name, verdict = plain_url(texts[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge(df.where("false")).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    bad = [(f"http://cheap-pills-{i}.example.net/buy?id={i}&ref={i * 7}&x={i}", 1) for i in range(150)]
    good = [(f"https://www.school.example.org/lesson/{i}", 0) for i in range(150)]
    labelled = spark.createDataFrame(bad[:100] + good[:100], "url string, blocked int")
    rows = urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(bad[100:] + good[100:])], "page_id bigint, url string"), (), labelled).collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] < 50) for r in rows)
    assert right >= 98 and all(r["rule"] is None for r in rows)


def test_held_out_agreement_with_rules(spark):
    """Trees that learn three quarters of the URLs that rules decide, against the rules on the last quarter: 176 of 198 agree
    (a path's first digit, which two rules go by, is no feature); the larger class alone gives fewer."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rules = urls.judge(pages).where("rule is not null").join(pages, "page_id").select("page_id", "url", (F.col("verdict") == "block").cast("int").alias("blocked"))
    asked = F.crc32(F.col("url")) % 4 == 2
    rows = urls.judge(rules.where(asked).select("page_id", "url"), (), rules.where(~asked)).join(rules, "page_id").collect()
    right = sum((r["verdict"] == "block") == bool(r["blocked"]) for r in rows)
    larger = max(sum(r["blocked"] for r in rows), sum(1 - r["blocked"] for r in rows))
    assert len(rows) > 100 and right >= 0.85 * len(rows) and right > 1.1 * larger, (right, larger, len(rows))


def test_odd_urls(spark):
    long = "http://h.example.com/" + "a/b?c=d&" * 20_000
    df = spark.createDataFrame([(1, long), (1, long), (None, "http://x.net/de/1"), (2, None)], "page_id bigint, url string").withColumn("score", F.lit("clash"))
    rows = urls.judge(df).collect()
    assert sorted(str(r["page_id"]) for r in rows) == ["1", "1", "2", "None"] and {r["verdict"] for r in rows} <= {"allow", "block"}
