"""URL filters, main text and WARC archives: each against a plain version, and on odd rows."""

import base64
import collections
import hashlib
import math
import re
import struct
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm import mincut_html, registry, url_model, warc_zstd

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long values, repeated rows, names that clash."""
    rows = [
        (1, "https://www.example.com/en/a?x", "<p>same"),
        (1, "https://www.example.com/en/a?x", "<p>same"),
        (2, None, None),
        (3, "", ""),
        (4, "no scheme", "<p>same"),
        (5, "http://Sub.EXAMPLE.net/fr/x#y", "x" * 300_000),
        (6, "http://example.org/" + "a" * 5000, "<p>other"),
        (None, "http://example.com", "<p>same"),
        (None, "http://a.com?q", "alone"),
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    clash = ["host", "path", "rule", "verdict", "score", "text", "n", "gram", "payload", "sha1", "number"]
    return frame.withColumns({name: F.lit("clash") for name in clash})


# --- urls ----------------------------------------------------------------------------

def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in registry.URL_RULES:
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start):
            best = max(best or ("", ""), (rule, verdict), key=lambda r: len(r[0]))
    return host, path, best


def plain_scores(urls):
    """Scores and threshold by dictionaries."""
    fold = lambda u: re.sub(r"[^a-z0/.\-]", "?", re.sub("[1-9]", "0", u.lower()))
    import zlib

    grams = lambda u: [("^^^" + fold(u))[i : i + 4] for i in range(len(u))]
    counts = {v: collections.Counter() for v in ("allow", "block")}
    for url in urls:
        best = plain_rule(url)[2]
        if url and best and zlib.crc32(url.encode()) % 5 != 0:
            for gram in grams(url):
                for k in range(1, 5):
                    counts[best[1]][gram[-k:]] += 1
    totals, kinds = {}, {}
    for v, seen in counts.items():
        totals[v], kinds[v] = collections.Counter(), collections.Counter()
        for gram, n in seen.items():
            totals[v][len(gram), gram[:-1]] += n
            kinds[v][len(gram), gram[:-1]] += 1

    def chance(v, gram):
        p = 1 / 32
        for k in range(1, 5):
            part = gram[-k:]
            n, t = totals[v][k, part[:-1]], kinds[v][k, part[:-1]]
            p = (counts[v][part] + t * p) / (n + t) if n else p
        return p

    ratio = {}
    for url in {u for u in urls if u}:
        found = grams(url)
        ratio[url] = sum(math.log(chance("allow", g)) - math.log(chance("block", g)) for g in found) / len(found)
    return ratio


def test_urls_against_dictionaries(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url")
    got = url_model.filter_urls(pages, registry.URL_RULES).collect()
    want = plain_scores([r.url for r in got])
    for r in got:
        host, path, rule = plain_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.score == pytest.approx(want[r.url], abs=1e-9)
        assert not rule or r.verdict == rule[1]
    free = [(r.score, r.verdict) for r in got if r.rule is None]
    allowed = [s for s, v in free if v == "allow"]
    blocked = [s for s, v in free if v == "block"]
    assert not allowed or not blocked or min(allowed) > max(blocked)


def test_odd_urls(odd):
    got = url_model.filter_urls(odd, registry.URL_RULES).collect()
    assert len(got) == odd.count() and all(r.verdict in ("allow", "block") for r in got)
    for r in got:
        host, path, rule = plain_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.url or r.score == 0
    assert url_model.filter_urls(odd.limit(0), registry.URL_RULES).count() == 0


def test_no_python_in_the_plan(odd):
    frame = url_model.filter_urls(odd, registry.URL_RULES)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_threshold_separates(spark):
    rows = [(0.5, "allow", 3), (0.4, "allow", 2), (-0.2, "block", 4), (0.45, "block", 1)]
    cut = url_model.calibrated(spark.createDataFrame(rows, "score double, verdict string, n long"))
    assert -0.2 < cut < 0.4
    assert url_model.calibrated(spark.createDataFrame(rows[:2], "score double, verdict string, n long")) == 0


# --- main text -----------------------------------------------------------------------

def test_minimum_cut_against_all_labellings():
    import itertools
    import random

    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 8)
        odds = [draw.choice([-3, -1, -0.5, 0.5, 1, 3]) + draw.random() / 100 for _ in range(n)]
        edges = [(a, b, draw.choice([0.5, 1.0])) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.4]

        def cost(kept):
            alone = sum(max(o, 0) * (not k) + max(-o, 0) * k for o, k in zip(odds, kept))
            return alone + sum(w * (kept[a] != kept[b]) for a, b, w in edges)

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(mincut_html.minimum_cut(odds, edges)) == pytest.approx(best)


ARTICLE = "The first paragraph says a good deal about the subject, and it goes on for a while."
PAGE = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style><script>var x = "<p>no</p>";</script></head>
<body class="no-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work well for all of you, do you agree?</p></div>
<article><header><h1>A &amp; B</h1></header><p>{ARTICLE}<p>Short.</p><div>Tail&nbsp;of
 it<br>here</div><!-- <p>hidden</p> --><aside>Related: a long list of other things to read on this site.</aside>
<div id="comments"><p>I have read this article with great interest, said a reader, and I agree.</p></div></article>
<form><label>Your name please, so that we can write to you about it.</label><input></form>
<div style="display: none"><p>Nobody sees this sentence, however long it may be in the end.</p></div>
<footer>&copy; Somebody</footer></body></html>"""


def test_main_text():
    assert mincut_html.main_text(PAGE) == f"A & B\n{ARTICLE}\nShort.\nTail of it here"
    plain = f"<body><div id=nav><a>One</a> <a>Two</a></div><h1>Title</h1><p>{ARTICLE}</p><p>are.</p><p>{ARTICLE}</p>"
    assert mincut_html.main_text(plain) == f"Title\n{ARTICLE}\nare.\n{ARTICLE}"
    for broken in ("", "<", "<p", "</", "<!--", "<script>x", "<a '", "&", "<nav>only menu</nav>", "<b" * 500):
        assert isinstance(mincut_html.main_text(broken), str)


STORY = [
    f"The {place} part of this story tells at some length what the council decided on Monday, and why. " * 3
    for place in ("first", "second", "third")
]
PROSE = "".join(f"<p>{part}</p>" for part in STORY)
REMARK = "I have read all of this with great interest, said one reader, and I do agree with it."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content-sidebar-wrap"><main><article>{PROSE}</article></main><div class=sidebar><p>{REMARK}</div></div>',
        f'<article><div class="elementor-widget-container">{PROSE}</div></article>',
        f"<form id=page><article>{PROSE}</article><button>Send</button></form>",
        f'<form id=page><div>{PROSE}</div><input></form><footer><a href="/">{REMARK}</a></footer>',
        f'<div class="page search-results">{PROSE}</div>',
        f'<div class="post social-news">{PROSE}</div><div class="social">{REMARK}</div>',
        f'<article class="post comments-open">{PROSE}</article>',
        f'<div title="hidden gems" data-role="navigation">{PROSE}</div>',
        f"<div data-x=it's>{PROSE}</div>",
        f"<select><option>{PROSE}",
        f'<div class="cookie-box"><p>{REMARK}</p></div><div>{PROSE}</div>',
        f'<article>{PROSE}<div class="discussion"><p>{REMARK}</p></div></article>',
        f'<article>{PROSE}<h3>3 Comments</h3><div class=u><p>{REMARK}</p></div></article>',
        f'<article>{PROSE}</article><section id=comments><article class="comment-body"><p>{REMARK}</p></article></section>',
        f'<article>{PROSE}<div itemtype="https://schema.org/Comment"><p>{REMARK}</p></div></article>',
        f'<article>{PROSE}<p hidden>{REMARK}</p></article>',
    ],
)
def test_wrappers_and_comments(page):
    assert mincut_html.main_text(f"<html><body>{page}</body></html>") == "\n".join(part.strip() for part in STORY)


def test_formulas_stay():
    page = f"<article><p>{STORY[0]} So <math><mi>x</mi><mo>=</mo><mn>3</mn></math> holds.</p></article>"
    assert mincut_html.main_text(page).endswith("So x=3 holds.")


@pytest.mark.parametrize(
    "unit", ['<a b="', "<a b=\">\" ", "<", "<b", "<!--", "<svg>", "<p>some words here. ", "<h2>3 comments</h2>x", "<a ===="]
)
def test_broken_markup_takes_linear_time(unit):
    began = time.process_time()
    mincut_html.main_text(unit * (1_000_000 // len(unit)))
    mincut_html.main_text("<div>" * 50_000 + "</p></x>" * 50_000)
    assert time.process_time() - began < 30  # quadratic time takes many minutes


def test_generated_articles(spark):
    for r in mincut_html.extract(spark.read.parquet(f"{SF_DIR}/pages.parquet").withColumn("copy", F.col("html"))).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r["copy"], re.S)[1]
        parts = [re.sub(r"<[^>]*>", " ", p) for p in re.split(r"</?(?:p|h1)>", inside)]
        import html

        assert r.text == "\n".join(" ".join(html.unescape(p).split()) for p in parts if html.unescape(p).split())


def test_odd_pages(odd):
    got = mincut_html.extract(odd)
    assert got.count() == odd.count() and got.where("text is null").count() == 0
    assert {r.text for r in got.where("page_id in (2, 3)").collect()} == {""}
    assert mincut_html.extract(odd.limit(0)).count() == 0


# --- archives ------------------------------------------------------------------------

def test_round_trip(spark, odd, tmp_path):
    pages = odd.select("page_id", "url", "html").union(
        spark.read.parquet(f"{SF_DIR}/pages.parquet").select(F.col("page_id") + 100, "url", "html")
    )
    for least in (0, 7):
        got = warc_zstd.round_trip(pages, f"{tmp_path}/{least}", least=least).collect()
        rows = pages.collect()
        assert len(got) == len(rows) and all(r.error is None for r in got)
        first = {}
        for r in rows:
            body = (r.html or "").encode()
            if r.page_id is not None:
                first[body] = min(first.get(body, r.page_id), r.page_id)
        want = collections.Counter()
        for r in rows:
            body = (r.html or "").encode()
            again = body in first and r.page_id != first[body] and len(body) >= least
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            kind = "revisit" if again else "response"
            want[(str(r.page_id), r.url, digest, len(body), kind, str(first[body]) if again else None)] += 1
        assert want == collections.Counter(
            (r.record_id, r.uri, r.digest, r.payload_bytes, r.record_type, r.refers_to) for r in got
        )
        held = {(r.record_id, bytes(r.payload)) for r in got if r.record_type == "response"}
        assert all((str(r.page_id), (r.html or "").encode()) in held for r in rows if least == 7 and len(r.html or "") < 7)
    assert warc_zstd.round_trip(pages.limit(0), f"{tmp_path}/none").count() == 0


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    folder = str(tmp_path)
    rows = warc_zstd.with_revisits(pages)
    warc_zstd.write_archives(rows.limit(7), folder, b"some words " * 9).collect()  # as of a lost attempt
    written = durable(warc_zstd.write_archives(rows, folder, b"some words " * 9, archive_bytes=300))
    assert warc_zstd.read_archives(spark, folder).count() == 47
    assert sorted(int(r.record_id) for r in warc_zstd.read_written(written, folder).collect()) == list(range(40))
    more = written.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="records gives"):
        warc_zstd.read_written(more, folder).collect()
    missing = written.withColumn("archive", F.concat(F.lit("x"), "archive"))
    with pytest.raises(Exception):
        warc_zstd.read_written(missing, folder).collect()


def archive(records, dictionary=b"some words of a dictionary " * 9):
    kind = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    encoder = zstandard.ZstdCompressor(dict_data=kind, write_checksum=True)
    leading = struct.pack("<II", warc_zstd.DICTIONARY_FRAME, len(dictionary)) + dictionary
    return leading + b"".join(map(encoder.compress, records))


def record(payload=b"some words", **change):
    digest = warc_zstd.digest_of(payload)
    return warc_zstd.record_bytes("response", "7", "http://x/", digest, len(payload), payload, None)


def test_faults_are_named():
    good = record()
    (row,) = warc_zstd.archive_records(archive([good]))
    assert row["error"] is None and row["payload"] == b"some words"
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9"),
        good.replace(b"some words", b"some wordz"),
        good.replace(b"some words", b"some more words"),
        good.replace(b"WARC-Date", b"X-Date"),
        good[:-2],
        b"",
    ):
        rows = list(warc_zstd.archive_records(archive([good, bad, good])))
        assert [r["error"] is None for r in rows] == [True, False, True]
    whole = archive([good, good])
    rows = list(warc_zstd.archive_records(whole[:-9]))
    assert rows[0]["error"] is None and rows[-1]["error"]
    assert list(warc_zstd.archive_records(b"not an archive"))[0]["error"]
    # A dictionary may be compressed itself; frames without any dictionary are read too.
    packed = zstandard.ZstdCompressor().compress(b"some words of a dictionary " * 9)
    body = archive([good])[8 + 27 * 9 :]
    held = struct.pack("<II", warc_zstd.DICTIONARY_FRAME, len(packed)) + packed + body
    assert next(warc_zstd.archive_records(held))["payload"] == b"some words"
    assert next(warc_zstd.archive_records(zstandard.ZstdCompressor().compress(good)))["payload"] == b"some words"
