"""Operators over pages, lists and sound against brute force, and their defined results for odd rows."""

import collections
import datetime
import html
import random
import re
import struct
import time

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tallywork.llm import chroma, queries, templates, urllists, warc

PAGES = "page_id long, url string, html string"
BODY = "x" * 120


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (1, "http://a.example.com/x", BODY), (2, "http://a.example.com/y y\n", BODY), (2, "http://a.example.com/y y\n", BODY), (3, None, BODY), (4, "http://b.example.com", "short"), (5, "http://b.example.com", "short"), (6, "", ""), (7, "no url", None),
        (None, None, None), (None, "http://c.example.com/", BODY), (8, "http://c.example.com/z", "<p>é" + "long text " * 20_000), (-9, "HTTP://User@A.Example.com:80/p?q#f", "<article><p>a<p>b"),
    ]
    return spark.createDataFrame(rows, PAGES).select("*", *[F.lit(0).alias(c) for c in ("digest", "first", "payload", "host", "text", "template", "h", "count", "row", "key", "month", "fetched", "list", "error")])


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)


# WARC


def test_pages_come_back_from_their_archives(spark, small):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{small}/pages.parquet'")
    got, want = queries.op1_warc_archive(spark, small).toPandas(), c.sql(queries.OP1_SQL).df()
    key = lambda d: sorted((int(r.page_id), int(r.payload_bytes), r.payload_digest, r.record_type, None if str(r.refers_to) in ("<NA>", "nan") else int(r.refers_to)) for r in d.itertuples())
    assert key(got) == key(want) and got["error"].isna().all()


def test_odd_pages_in_archives(odd_pages, no_pages):
    rows = warc.read(warc.written(odd_pages)).collect()
    assert len(rows) == odd_pages.count() and all(r["error"] is None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["record_id"], []).append(r)
    assert [r["record_type"] for r in by["urn:x-page:1"]] == ["response"]
    assert {(r["record_type"], r["refers_to"], r["payload_bytes"]) for r in by["urn:x-page:2"]} == {("revisit", "urn:x-page:1", 120)} and len(by["urn:x-page:2"]) == 2
    assert by["urn:x-page:4"][0]["record_type"] == by["urn:x-page:5"][0]["record_type"] == "response"
    assert by["urn:x-page:7"][0]["payload_bytes"] == 0 and len(by["urn:x-page:none"]) == 2
    assert bytes(by["urn:x-page:-9"][0]["payload"]) == b"<article><p>a<p>b"
    assert warc.read(warc.written(no_pages)).count() == 0


def test_archives_as_files(spark, tmp_path, odd_pages):
    for k, r in enumerate(warc.written(odd_pages).collect()):
        (tmp_path / f"{k}.warc.zst").write_bytes(r["content"])
    assert warc.read_files(spark, str(tmp_path)).count() == odd_pages.count()


def test_archives_begin_with_their_dictionary(odd_pages):
    content = bytes(warc.written(odd_pages).first()["content"])
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and zstandard.get_frame_parameters(content[8 + size :]).window_size >= 0


def test_broken_records_are_named():
    good = warc.record(1, "http://a/", b"payload", warc.hashlib.sha256(b"payload").hexdigest(), None)
    assert list(warc.records(warc.archive([good])))[0]["payload"] == b"payload"
    cases = {
        good.replace(b"WARC/1.1", b"WARC/9", 1): "version", good.replace(b"WARC-Date", b"WARC-Dote", 1): "warc-date", good[:-4]: "no end", good.replace(b"payload\r\n\r\n", b"payloads\r\n\r\n"): "Content-Length",
        good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"): "digest", b"WARC/1.1\r\nbad": "don't end", good.replace(b"Content-Length: 7", b"Content-Length: 8", 1): "HTTP says", re.sub(rb"(?s)(.*)Content-Length: \d+", rb"\1Content-Length: x", good.split(b"\r\n\r\n")[0]) + b"\r\n\r\n": "not a length",
    }
    for data, said in cases.items():
        (r,) = warc.records(warc.archive([data]))
        assert said in r["error"], (said, r["error"])
    whole = warc.archive([good, good, good])
    assert [r["error"] is None for r in warc.records(whole[:-5])] == [True, True, False]
    assert [r["error"] is None for r in warc.records(whole[:6])] == [False]
    assert list(warc.records(b"")) == []


def test_a_bare_dictionary_and_other_skippable_frames():
    good = warc.record(1, None, b"p" * 500, warc.hashlib.sha256(b"p" * 500).hexdigest(), None)
    raw = good[:300]
    compressed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(good)
    content = struct.pack("<II", 0x184D2A5D, len(raw)) + raw + struct.pack("<II", 0x184D2A50, 3) + b"abc" + compressed
    assert [r["error"] for r in warc.records(content)] == [None]
    plain = zstandard.ZstdCompressor().compress(good)
    assert [r["error"] for r in warc.records(plain + plain)] == [None, None]


# Main text


def test_articles_of_all_pages(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op8_site_templates(spark, small).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_what_repeats_on_a_site_goes(spark):
    page = lambda k: f"<html><body><div>Home | News | About us</div><div><p>Story number {k} tells of {k * 7} things.</p></div><div><span>Made by the same people</span></div></body></html>"
    rows = [(k, f"http://s.example.com/{k}", page(k)) for k in range(12)] + [(100, "http://other.example.com/", page(100))]
    got = {r["page_id"]: r["text"] for r in templates.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "Story number 3 tells of 21 things."
    assert got[100].startswith("Home | News")  # one page of a host tells nothing


def test_repeated_passages_of_articles_stay(spark):
    rows = [(k, f"http://s.example.com/{k}", f"<nav>menu</nav><article><h1>T{k}</h1><p>Same licence everywhere.</p><div class='share'>x</div><p>Own {k}</p></article>") for k in range(12)]
    got = templates.extracted(spark.createDataFrame(rows, PAGES)).first()
    assert got["text"].split("\n") == [f"T{got['page_id']}", "Same licence everywhere.", f"Own {got['page_id']}"]


@pytest.mark.parametrize("source, want", [
    ("", ""), (None, ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<br>c</p>d", "a\nb c\nd"), ("<p>x &lt;b&gt; &eacute;&#233;&#xe9;</p>", "x <b> ééé"), ("<script>if (a<b) {'</p>'}</script>t<style>x</style>", "t"),
    ("<body><header>h</header><main><header><h1>T</h1></header><p>b</p><aside>s</aside><form>f</form></main><footer>f</footer>", "T\nb"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<div class='cookie-notice'>c</div><div id=comments>r</div><div class='ad'>x</div><div class='header-image lead'>y</div>", "y"), ("<p>a <!-- <p>no</p> --> b</p>", "a b"), ("<p title='a>b'>t</p>", "t"), ("<p>un<b>closed <i>tags", "unclosed tags"),
    ("<article>one<article>two</article></article>three", "one\ntwo"), ("</p></div>x<", "x<"), ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"), ("<p>a\n \t b c</p>", "a b c"), ("<textarea>t</textarea><title>x</title>v", "v"), ("<![CDATA[x]]>y", "xy"), ("a<!--", "a"),
    ("<div class='post'><p>a</p><div class='post-meta'>by x</div></div><div class='related-story'>r</div><div class='note'>n</div>", "a\nby x"), ("<div class='related-story'>r</div><div class='content'>c</div>", "c"), ("<section id=comments><article>r</article></section><article>a</article>", "a"),
])
def test_blocks(source, want):
    assert templates.Page(source).main_text() == want


def test_long_and_broken_pages_take_linear_time():
    n = 100_000
    cases = {"<a " * n: None, "<a '" * n: None, "<a \">" * n + "x": None, "<b>" * n + "</i>" * n + "x": "x", "<i><div>" + "<b>" * n + "</i>" * n + "x": "x", "<p>" * n + "x": "x", "<script " * n + ">": "", "<!--" * n: "", "&#" + "9" * n + ";": "\ufffd", "<title>" + "</title " * n: "", "<" * n: "<" * n, "<a\"'>" * n: None}
    for source, want in cases.items():
        began = time.perf_counter()
        got = templates.Page(source).main_text()
        assert time.perf_counter() - began < 20 and want in (None, got), source[:30]


def test_attributes_are_read_only_where_they_can_tell(monkeypatch):
    class Counted:
        read: list[str] = []

        def findall(self, text):
            self.read.append(text)
            return pattern.findall(text)

    pattern = templates.ATTRIBUTE
    monkeypatch.setattr(templates, "ATTRIBUTE", Counted())
    told = ("CLASS='ad'", "Id=comments", "ROLE=navigation", "Hidden", "aria-hidden='true'", "style='Display: none'")
    page = "".join(f"<p>k{k} <a href='/{k}'>x</a><br/><img src=y></p>" for k in range(50)) + "".join(f"<div {t}>gone</div>" for t in told) + "<div title='not hidden'>kept</div>"
    assert templates.Page(page).main_text() == "\n".join([*(f"k{k} x" for k in range(50)), "kept"])
    assert len(Counted.read) == len(told) + 1


def test_pages_without_templates_are_not_hashed(monkeypatch):
    pages = ["", None, "x<p>a<br>b", "<nav>n</nav><main><p>a</p><div class=ad>d</div></main>", "<![CDATA[a]]b]]><!-- c --><!doctype d><? e ?>f", "<form><article>a</article></form><form>f</form>", "<header>h</header><article><header>own</header>a</article>"]
    want = [templates.Page(p).main_text() for p in pages]
    assert want == ["", "", "x\na b", "a", "a]]bf", "a", "own\na"]
    monkeypatch.setattr(templates.xxhash, "xxh64_intdigest", lambda *_: pytest.fail("hashed"))
    assert [templates.Page(p, hashed=False).main_text() for p in pages] == want


def test_copies_of_a_page_keep_their_text(spark):
    body = "<div>Home | News</div><div><p>One story of some length, told once on this site.</p></div><div>Made by us</div>"
    stamp = lambda k: f"<div>Home | News</div><div><p>A page of some length that was fetched many times.</p></div><div>seen {k} times</div>"
    own = lambda k: f"<div>Home | News</div><div><p>Story number {k} tells of {k * 7} things.</p></div><div>Made by us</div>"
    rows = [(k, "http://s.example.com/a", body) for k in range(9)] + [(20 + k, "http://s.example.com/b", stamp(k)) for k in range(9)] + [(40 + k, f"http://s.example.com/{k}", own(k)) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in templates.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "One story of some length, told once on this site."
    assert got[25] == "A page of some length that was fetched many times.\nseen 5 times" and got[45] == "Story number 5 tells of 35 things."


def test_templates_are_those_of_brute_force(spark):
    """Counts by host with a parser of its own kind: sets of surroundings for each block."""
    g = random.Random(6)
    rows, seen, whole = [], collections.defaultdict(set), collections.defaultdict(set)
    for k in range(400):
        host = g.choice(["a", "a", "a", "b", "c"])
        blocks = [f"<div>{x}</div>" for x in (f"menu {g.randrange(30)}", f"own {g.randrange(60)} text that is long enough to be the main one here", f"foot {g.randrange(3)}")]
        rows.append((k, f"http://{host}.example.com/{k}", "".join(blocks)))
        for i, b in enumerate(blocks):
            if len(b) < 30:
                seen[host, b].add(tuple(sorted(blocks[:i] + blocks[i + 1 :])))
        whole[host].add(tuple(sorted(blocks)))
    want = collections.Counter(h for (h, _), s in seen.items() if len(s) >= 5 and (len(s) >= 0.3 * len(whole[h]) or len(s) >= 50))
    got = {r["host"].split(".")[0]: len(r["template"]) for r in templates.templates(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == dict(want)


def test_deep_and_odd_pages(odd_pages, no_pages):
    assert templates.Page("<div>" * 50_000 + "x").main_text() == "x"
    rows = templates.extracted(odd_pages).collect()
    assert len(rows) == odd_pages.count() and {r["page_id"]: r["text"] for r in rows}[-9] == "a\nb"
    assert templates.extracted(no_pages).count() == 0


# URL lists


def test_lists_agree_with_sql(spark, small):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{small}/pages.parquet'")
    got, want = queries.op7_url_lists(spark, small).toPandas(), c.sql(queries.OP7_SQL).df()
    key = lambda d: sorted((r.page_id, r.url, str(r.fetched)[:10], r.n_matches, str(r.list).replace("nan", "None"), str(r.entry).replace("nan", "None"), bool(r.blocked)) for r in d.itertuples())
    assert key(got) == key(want) and got["blocked"].any() and not got["blocked"].all()


def test_entries_hold_from_addition_to_removal(spark, odd_pages, no_pages):
    d = lambda m, day: datetime.date(2024, m, day)
    events = spark.createDataFrame([("l", "example.com", d(1, 10), "add"), ("l", "example.com", d(1, 10), "add"), ("l", "example.com", d(2, 5), "add"), ("l", "example.com", d(4, 1), "remove"), ("l", "a.example.com/x", d(5, 1), "add"), ("l", "a.example.com/x", d(5, 1), "remove"), ("m", "a.example.com/x", d(6, 1), "add"), ("m", None, d(6, 1), "add")], "list string, entry string, day date, action string")
    days = [d(1, 9), d(1, 10), d(3, 31), d(4, 1), d(5, 1), d(6, 1), d(12, 31), None]
    caps = spark.createDataFrame([(k, "http://a.example.com/x/y?z", t) for k, t in enumerate(days)], "page_id long, url string, fetched date")
    got = {r["page_id"]: r for r in urllists.judged(caps, events).collect()}
    assert [got[k]["blocked"] for k in range(8)] == [False, True, True, False, False, True, True, False]
    assert got[1]["entry"] == "example.com" and got[5]["list"] == "m"
    assert {(r["entry"], r["valid_from"], r["valid_to"]) for r in urllists.intervals(events).collect()} == {("example.com", d(1, 10), d(4, 1)), ("a.example.com/x", d(6, 1), None)}
    odd = odd_pages.withColumn("fetched", F.lit(d(2, 1)))
    rows = urllists.judged(odd, events).collect()
    assert len(rows) == odd.count() and {r["page_id"]: r["blocked"] for r in rows}[-9] and not any(r["blocked"] for r in rows if not r["url"])
    assert urllists.judged(caps.limit(0), events).count() == 0 and not any(r["blocked"] for r in urllists.judged(caps, events.limit(0)).collect())


def test_long_hosts_and_paths_and_other_cases_of_a_scheme_match(spark):
    d = datetime.date(2024, 1, 1)
    deep = ".".join("abcdefghij") + ".example.com"
    entries = [deep, "b.example.com/1/2/3/4", "c.example.com/x"]
    events = spark.createDataFrame([("l", e, d, "add") for e in entries], "list string, entry string, day date, action string")
    urls = {f"http://{deep}/p": entries[0], f"http://www.{deep}/p": entries[0], "http://b.example.com/1/2/3/4/5": entries[1], "http://b.example.com/1/2/3": None, "HTTP://c.example.com/x/y": entries[2], "Https://C.example.com/X": None, f"http://{deep[2:]}": None}
    caps = spark.createDataFrame([(k, u, d) for k, u in enumerate(urls)], "page_id long, url string, fetched date")
    assert {r["url"]: r["entry"] for r in urllists.judged(caps, events).collect()} == urls


def test_one_form_of_urls_and_entries(spark):
    d = datetime.date(2024, 1, 1)
    pairs = {
        "y.com/a": ["http://y.com/a/b", "HTTP://y.com/a/b", "http://Y.com./a", "http://u:p@y.com:8080/a?q", "http://y.com//a", "http://y.com/%61", "http://a.y.com/a#x"], "z.com/a%2Fb": ["http://z.com/a%2fb"], "https://Q.com/caf%C3%A9/": ["http://q.com/café", "http://q.com/caf%c3%a9/x"],
        "p.com/1+1": ["http://p.com/1+1", "http://p.com/1%2B1"], "[2001:db8::1]": ["http://[2001:DB8::1]:80/x"], "r.com/100%": ["http://r.com/100%", "http://r.com/100%25"],
    }
    none = ["http://y.com/A", "http://z.com/a/b", "http://z.com/a", "http://xy.com/a", "y.com/a", "http:///a", "http://p.com/1%201", "mailto:a@y.com/a", "http://r.com/100"]
    events = spark.createDataFrame([("l", e, d, "add") for e in [*pairs, "", None, "/a"]], "list string, entry string, day date, action string")
    urls = [*(u for us in pairs.values() for u in us), *none]
    caps = spark.createDataFrame([(k, u, d) for k, u in enumerate(urls)], "page_id long, url string, fetched date")
    got = {r["url"]: r["blocked"] for r in urllists.judged(caps, events).collect()}
    assert {u for u, b in got.items() if not b} == set(none)


def test_events_long_before_the_first_capture_give_few_intervals(spark, tmp_path):
    events = spark.createDataFrame([("l", "a.com", datetime.date(1, 2, 3), "add"), ("l", "b.com", datetime.date(1, 1, 1), "add"), ("l", "b.com", datetime.date(2000, 1, 1), "remove")], "list string, entry string, day date, action string")
    caps = spark.createDataFrame([(k, f"http://{h}/", datetime.date(2024, 5, 6)) for k, h in enumerate(["a.com", "b.com"])], "page_id long, url string, fetched date")
    assert [r["blocked"] for r in sorted(urllists.judged(caps, events).collect())] == [True, False]


# Sound


def test_integral_images_give_the_sums_of_the_filters():
    frames = np.random.default_rng(2).uniform(size=(20, chroma.CLASSES))
    got = chroma.packed(frames)
    wide = np.concatenate([frames, frames], axis=1)
    for t in range(len(frames) - chroma.SPAN + 1):
        x = 0
        for kind, c, height, width in chroma.FILTERS:
            area = wide[t : t + width, c : c + height]
            part = sum(area[int(width * a) : int(width * b), int(height * p) : int(height * q)].sum() for p, q, a, b in chroma.HALVES[kind])
            level = int(np.digitize(np.log((part + 0.01) / (max(area.sum() - part, 0) + 0.01)), chroma.CUTS))
            x = x << 2 | (level ^ level >> 1)
        assert int(got[t]) == x


def tone(notes):
    t = np.arange(chroma.NOTE_SAMPLES) / chroma.RATE
    return np.concatenate([8000 * np.sin(2 * np.pi * 110 * 2 ** (n / 12) * t) for n in notes]).astype("<i2").tobytes()


def test_shifted_and_noisy_recordings_align(spark):
    g = np.random.default_rng(3)
    a, b = g.integers(0, 24, 64), g.integers(0, 24, 64)
    noise = (np.frombuffer(tone(a), "<i2") + g.normal(0, 900, 64 * chroma.NOTE_SAMPLES)).astype("<i2").tobytes()
    rows = [(50, tone(a)), (51, tone(a)), (52, tone(a[5:])), (53, tone(b)), (54, noise), (55, None), (56, b""), (57, b"\x00"), (None, tone(b))]
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "id long, pcm binary")
    pairs, members = chroma.aligned(chroma.fingerprints(df), "id % 50 = 0")
    got = {r["class_id"]: r for r in pairs.collect()}
    assert set(got) == {52, 54} and got[52]["offset"] == -5 and got[54]["offset"] == 0
    assert {r["id"]: r["class_id"] for r in members.collect()} == {50: 50, 51: 50, 52: 52, 53: 53, 54: 54, 55: 55, 56: 55, 57: 55, None: 53}
    none, nobody = chroma.aligned(chroma.fingerprints(df.limit(0)), "id % 50 = 0")
    assert none.count() == 0 and nobody.count() == 0


def by_bit_errors(a, b):
    """The best alignment over all offsets, by bit errors alone."""
    found = []
    for o in range(-len(a) + chroma.MIN_OVERLAP, len(b) - chroma.MIN_OVERLAP + 1):
        lo, hi = max(0, -o), min(len(a), len(b) - o)
        wrong = int(np.bitwise_count(a[lo:hi] ^ b[lo + o : hi + o]).sum())
        if hi - lo >= chroma.MIN_OVERLAP and wrong <= 32 * chroma.MAX_ERROR * (hi - lo):
            found.append((wrong / (hi - lo), -(hi - lo), abs(o), o, hi - lo, wrong))
    return min(found)[3:] if found else None


def check_alignments(marked, hot=chroma.HOT):
    """Each alignment found is one by bit errors; the share of those that are found, and how many there are."""
    fp = {r["id"]: np.array(r["fp"], np.uint64) for r in marked.collect()}
    pairs, members = chroma.aligned(marked, "id % 50 = 0", hot=hot)
    home = {r["id"]: r["class_id"] for r in members.collect()}
    want = {(q, c): x for q in {home[k] for k in fp if k % 50 == 0} for c in set(home.values()) - {q} if (x := by_bit_errors(fp[q], fp[c]))}
    got = {(r["query_class"], r["class_id"]): (r["offset"], r["overlap"], r["errors"]) for r in pairs.collect()}
    assert set(got) <= set(want) and all(got[k][2] / got[k][1] >= want[k][2] / want[k][1] for k in got)
    same = sum(got.get(k) == x for k, x in want.items())
    return same / len(want) if want else 1.0, len(want)


def test_recall_against_all_offsets(spark, small):
    recall, _ = check_alignments(chroma.fingerprints(chroma.played(spark.read.parquet(f"{small}/embeddings.parquet"))))
    assert recall >= 0.9
    g = np.random.default_rng(8)
    rows = []
    for k in range(12):
        notes = g.integers(0, 24, 64)
        rows.append((50 * k, tone(notes)))
        for j, noise in enumerate((500, 1000, 2000, 4000, 8000)):
            cut = int(g.integers(0, 12))
            rows.append((50 * k + 1 + j, (np.frombuffer(tone(notes[cut:]), "<i2") + g.normal(0, noise, (64 - cut) * chroma.NOTE_SAMPLES)).astype("<i2").tobytes()))
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id long, pcm binary")
    recall, n = check_alignments(chroma.fingerprints(df))
    assert n >= 40 and recall >= 0.95


def test_what_is_common_votes_in_pairs_and_fours(spark):
    """Recordings that begin and end with silence, which meets nobody by itself."""
    g = np.random.default_rng(5)
    rows = []
    for k in range(30):
        notes = g.integers(0, 24, 40)
        quiet = np.zeros(16 * chroma.NOTE_SAMPLES, "<i2").tobytes()
        rows.append((50 * k, quiet + tone(notes) + quiet))
        rows.append((50 * k + 1, tone(notes) + quiet))
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id long, pcm binary")
    marked = chroma.fingerprints(df)
    tables = [t.groupBy("key").count().agg(F.max("count")).first()[0] for t in chroma.keyed(marked.selectExpr("id as class_id", "true as asks", "fp"), 20)]
    assert tables[0] <= 20
    recall, n = check_alignments(marked, hot=20)
    assert n >= 30 and recall >= 0.9
    held = spark.createDataFrame([(50 * k, bytearray(tone([7] * (40 + k)))) for k in range(10)], "id long, pcm binary")
    chroma.aligned(chroma.fingerprints(held), "id % 50 = 0", hot=5)[0].collect()  # ends


def test_what_is_common_loses_no_alignment(spark):
    """Held notes share nothing but one integer, which nearly all places have; and any bound gives the same alignments."""
    held = spark.createDataFrame([(50 * k, bytearray(tone([7] * (40 + k)))) for k in range(10)], "id long, pcm binary")
    assert check_alignments(chroma.fingerprints(held), hot=5) == (1.0, 90)
    g = np.random.default_rng(6)
    notes, quiet = g.integers(0, 24, 30), np.zeros(16 * chroma.NOTE_SAMPLES, "<i2").tobytes()
    rows = [(50 * k, quiet + tone(notes[:k]) + quiet + tone([3] * 12)) for k in range(2, 14)]
    marked = chroma.fingerprints(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id long, pcm binary"))
    found = [sorted(map(tuple, chroma.aligned(marked, "id % 50 = 0", hot=hot)[0].collect())) for hot in (3, 20, 10**9)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "with-menu", "content-share", "ad-free", "search-results", "related-post", "comments-open", "widget"])
def test_class_words_of_wrappers_leave_the_article(name):
    from tallywork.llm.templates import Page

    assert Page(f'<div class="{name}"><article><p>Main text here.</p></article></div><div class="sidebar">Side</div>').main_text() == "Main text here."


def test_only_whole_class_names_say_what_goes():
    from tallywork.llm.templates import Page

    page = '<article><p>One.</p><div class="share-price-table">Price 3</div><p class="menu-item-note">Note.</p><div class="social-share">Share me</div><div class="post-comments">I agree</div><form>Name</form></article><article class="related">Other story</article>'
    assert Page(page).main_text() == "One.\nPrice 3\nNote."
    assert Page("<body><form id='aspnetForm'><div><p>The whole page lies in a form.</p></div></form></body>").main_text() == "The whole page lies in a form."
    assert Page("<body><p>Short.</p><div class='comments'><p>A reader says much more than the page itself does.</p></div></body>").main_text() == "Short."


def test_a_long_name_of_a_tag_takes_no_square_of_time():
    import time

    from tallywork.llm.templates import Page

    began = time.perf_counter()
    Page("<" + "a" * 1_000_000 + ' "x >').main_text()
    assert time.perf_counter() - began < 3


def test_captures_meet_entries_of_one_label_and_walk_dots(spark):
    import datetime

    from tallywork.llm import urllists

    day = datetime.date(2024, 5, 1)
    events = spark.createDataFrame([("l", e, datetime.date(2024, 1, 1), "add") for e in ("zip", "x.org/adult")], "list string, entry string, day date, action string")
    urls = ["http://a.b.zip/x", "http://zip/", "  http://c.zip\n", "http://zipper/", "http://x.org/p/../adult/x", "http://x.org/./adult", "http://x.org/../adult", "http://x.org/adult/..", "http://x.org/p/adult"]
    got = urllists.judged(spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched date"), events)
    assert [r["entry"] for r in got.orderBy("page_id").collect()] == ["zip", "zip", "zip", None, *["x.org/adult"] * 3, None, None]
