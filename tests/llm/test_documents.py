"""Operators over documents against brute force, and their defined results for odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywork.llm import mixing, packing, quality, queries, secrets, simhash, surrogates

WORD = r"[^\x20\x09-\x0D]+"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# Packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def check_pieces(rows, expected, window):
    """expected: ids of each document, as often as it occurs."""
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:
        assert r["sequence_id"] * window + r["offset"] == at and r["length"] > 0
        at += r["length"]
        assert r["offset"] + r["length"] <= window
    for key, lists in expected.items():
        counts = collections.Counter()
        for r in got[key]:
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in lists)
            counts[r["doc_tokens"]] += r["length"]
        assert sum(counts.values()) == sum(map(len, lists))
    assert at == sum(len(x) for lists in expected.values() for x in lists)


def test_packing_gives_each_id_once(spark, small, docs):
    t = tokenizer()
    expected = {k: [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")] for k, x in texts(docs).items()}
    check_pieces(queries.op2_concat_cut(spark, small).collect(), expected, 2048)


def test_packing_of_odd_documents(odd_docs, empty_docs):
    t, expected = tokenizer(), collections.defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        expected[r["doc_id"]].append(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces = packing.packed(odd_docs, queries.tokenizer_path(), window=64)
    check_pieces(pieces.select("*", F.crc32("ids").alias("ids_crc32")).collect(), expected, 64)
    assert packing.packed(empty_docs, queries.tokenizer_path()).count() == 0


def test_words_put_together_are_the_tokenizers_ids():
    w, t = packing.Words(queries.tokenizer_path()), tokenizer()
    g = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "don't", "it's", "x,", "'s", "é", "日本", "12", "3.5%", "...", "\x1c", " ", "<|endoftext|>", "(ab)", "CamelCase", "-", "ABC!!", "Ġx"]
    some = ["".join(g.choice(parts) for _ in range(g.randrange(12))) for _ in range(3000)] + ["", " ", "a", " a", "a "]
    for text, ids in zip(some, w.ids(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgotten_and_very_long_words_have_the_same_ids(monkeypatch):
    """A memory of a few words, and words of 30,000 characters that occur once or again."""
    monkeypatch.setattr(packing, "REMEMBERED", 2000)
    w, t = packing.Words(queries.tokenizer_path()), tokenizer()
    g = random.Random(5)
    long_ = ["".join(g.choice("abcxyz019") for _ in range(30_000)) for _ in range(6)]
    some = [" ".join(g.choice([*long_, *(f"w{i}" for i in range(200)), "plain", "words,", "again."]) for _ in range(g.randrange(1, 40))) for _ in range(30)]
    for text in some:
        assert np.frombuffer(w.ids([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(w.known) + len(w.old) < 200


# Mixing


def limits(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def check_mix(rows, docs):
    """Each source's words within four standard errors of a multinomial draw of blocks, and a block at either end."""
    size = collections.Counter()
    for r in docs.select("doc_id", "source", "text").collect():
        size[r["source"]] += len(re.findall(WORD, r["text"] or ""))
    want = limits(size)
    by = {(r["doc_id"], r["source"]): None for r in docs.select("doc_id", "source").collect()}
    sources = collections.defaultdict(set)
    for k, s in by:
        sources[k].add(s)
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = next(s for s in sources[r["doc_id"]] if size[s] == r["source_size"])
        assert r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 4 * (want[s] * mixing.BLOCK) ** 0.5 + 4 * mixing.BLOCK
    return taken


def test_mixing_comes_near_its_targets(spark, small, docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()))


def test_mixing_stops_at_three_times_a_source(spark):
    rows = [(i, "w " * 200, "big", 0) for i in range(200)] + [(1000 + i, "w " * 50, None, 0) for i in range(3)] + [(2000, "w " * 999, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x int")
    out = mixing.mixed(docs).collect()
    check_mix(out, docs)
    small = [r for r in out if r["doc_id"] == 2000][0]
    assert small["target"] == 3 * 999 and 2.7 * 999 <= small["taken"] <= 3 * 999


def test_mixing_of_odd_documents(odd_docs, empty_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mixed(empty_docs).count() == 0 and mixing.resampled(empty_docs).columns == empty_docs.columns
    again = mixing.resampled(odd_docs)
    assert again.columns == odd_docs.columns and again.where("doc_id = 6").count() >= 1


def spark_hash(*values):
    """XXH64 of values in a row, each with the hash of those before as its seed, as a signed number: (value, bytes) or text."""
    h = 42
    for v in values:
        h = h if v is None else xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def taken_by_hand(rows, weights=(5, 2, 1), block=mixing.BLOCK, seed=1):
    """Words taken from each of rows (doc_id, source, text), slot by slot."""
    size = [len(re.findall(WORD, t or "")) for _, _, t in rows]
    totals = collections.Counter()
    for (_, s, _), n in zip(rows, size, strict=True):
        totals[s] += n
    want = limits(totals, weights)
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    edge = np.cumsum([want[s] for s in order]) / sum(want.values())
    edge[-1] = 1.0
    slots = max(1, round(sum(size) / block))
    numbers = [(spark_hash((seed, 4), (k, 8)) % 2**64 >> 11) * 2.0**-53 for k in range(slots)]
    drawn = collections.Counter(np.searchsorted(edge, numbers, side="right").tolist())
    copies = collections.Counter()
    for s, n in drawn.items():
        blocks = -(-totals[order[s]] // block)
        for j in range(min(n, 3 * blocks)):
            at, key = j % blocks, ((seed, 4), (s, 4), (j // blocks, 8))
            for r in range(1, mixing.ROUNDS + 1):
                mirror = (spark_hash(*key, (r, 4)) - at) % blocks
                if spark_hash(*key, (r, 4), (max(at, mirror), 8)) & 1:
                    at = mirror
            copies[s, at] += 1
    taken = [0] * len(rows)
    for s, name in enumerate(order):
        mine = [i for i, r in enumerate(rows) if r[1] == name]
        chunks = -(-len(mine) // mixing.CHUNK_ROWS)
        mark = {i: spark_hash(rows[i][2]) for i in mine}
        of = {i: spark_hash(None if rows[i][0] is None else (rows[i][0], 8), (mark[i], 8)) % chunks for i in mine}
        first = 0
        for i in sorted(mine, key=lambda i: (of[i], rows[i][0] is not None, rows[i][0] or 0, mark[i])):
            for w in range(first, first + size[i]):
                taken[i] += copies[s, w // block]
            first += size[i]
    return size, taken, drawn, slots, edge


def test_mixing_takes_what_slots_drawn_by_hand_take(docs, odd_docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 7)
    for d in (docs, odd_docs):
        rows = [tuple(r) for r in d.select("doc_id", "source", "text").collect()]
        size, taken, drawn, slots, edge = taken_by_hand(rows)
        want = sorted(((r[0], n, t) for r, n, t in zip(rows, size, taken, strict=True)), key=repr)
        assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in mixing.mixed(d).collect()), key=repr) == want
        shares = np.diff(np.concatenate(([0], edge)))
        for s, p in enumerate(shares.tolist()):
            assert abs(drawn[s] - slots * p) <= 4 * (slots * p * (1 - p)) ** 0.5 + 1


def test_the_mix_holds_the_words_taken(docs, odd_docs):
    for d in (docs, odd_docs):
        rate = collections.Counter()
        for r in mixing.mixed(d, block=mixing.TEXT_BLOCK).collect():
            rate[r["doc_id"]] += r["taken"]
        texts_of = collections.defaultdict(list)
        for r in d.collect():
            texts_of[r["doc_id"]].append(re.findall(WORD, r["text"] or ""))
        got = collections.Counter()
        mix = mixing.resampled(d, chars="n_chars")
        assert mix.columns == d.columns and mix.dtypes == d.dtypes
        for r in mix.collect():
            words = re.findall(WORD, r["text"])
            got[r["doc_id"]] += len(words)
            assert len(r["text"]) == r["n_chars"] and any(set(words) <= set(t) for t in texts_of[r["doc_id"]])
        assert {k: v for k, v in rate.items() if v} == dict(got)


def test_partly_taken_texts_are_runs_of_their_words(spark):
    words = [f"w{i}" for i in range(1000)]
    rows = [(1, "\n".join(words), "a"), (2, " ".join(f"v{i}" for i in range(4000)), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = [r["text"].split() for r in mixing.resampled(df, block=16).where("doc_id = 2").collect()]
    assert one
    for t in one:
        at = [int(w[1:]) for w in t]
        assert at == sorted(set(at)) and sum(b - a != 1 for a, b in zip(at, at[1:], strict=False)) <= len(at) / 16 + 1


def test_prefix_sums_of_many_chunks(spark, monkeypatch):
    from tallywork.llm import common

    monkeypatch.setattr(common, "CHUNKS", 3)
    df = spark.range(500).selectExpr("cast(id % 2 as int) as k", "id div 20 as c", "id", "id % 7 as v")
    rows = sorted(common.starts(df, "k", "c", ["id"], "v", "before", "n").collect(), key=lambda r: r["id"])
    sums = [0, 0]
    for r in rows:
        assert r["before"] == sums[r["k"]]
        sums[r["k"]] += r["v"]


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 64, 1001):
        p = [r["p"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()]
        assert sorted(p) == list(range(n)) and (n < 64 or p != sorted(p))


# Quality


def counts(text):
    words, seen, dup = re.findall(WORD, text or ""), set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    where = collections.defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    inside = {j for x in where.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def check_quality(df, docs):
    rows = collections.Counter(tuple(r) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        c = counts(r["text"])
        want[(r["doc_id"], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert rows == want


def test_quality_counts(spark, small, docs, odd_docs, empty_docs):
    check_quality(queries.op6_quality_cascade(spark, small), docs)
    check_quality(quality.scored(odd_docs), odd_docs)
    assert quality.scored(empty_docs).count() == 0 and quality.accepted(empty_docs).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark, small):
    found = queries.op6_quality_cascade(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("n_words >= 20")
    assert found.where("quality = 1 and not kept").count() == 0
    assert found.where("quality = 0 and kept").count() <= 0.05 * found.where("quality = 0").count()


def test_order_of_rules_changes_no_verdict(docs, odd_docs):
    for d in (docs, odd_docs):
        first = quality.scored(d, quality.RULES).select("doc_id", "kept")
        second = quality.scored(d, quality.RULES[::-1]).select("doc_id", "kept")
        assert first.exceptAll(second).count() == 0
        kept = quality.accepted(d)
        assert kept.columns == d.columns and kept.count() == first.where("kept").count()


def test_selective_cheap_rules_come_first(docs):
    order = quality.ordered(docs)
    assert set(order) == set(quality.RULES) and len(quality.measured(docs)) == len(quality.RULES)


def test_repeated_windows():
    assert quality.repeated_words([b"%d" % i for i in range(9)] * 2) == 18
    assert quality.repeated_words([b"a"] * 8) == 0 and quality.repeated_words([b"a"] * 9) == 9 and quality.repeated_words([]) == 0


# Secrets

TOKEN = "0123456789abcdef01234567"


def base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans(spark, small, docs, odd_docs, empty_docs):
    for d in (docs, odd_docs):
        want = collections.Counter((r["doc_id"], secrets.joined(base(r["text"] or ""))) for r in d.select("doc_id", "text").collect())
        assert want == collections.Counter((r["doc_id"], r["base_spans"]) for r in secrets.scanned(d).collect())
    r = queries.op9_secret_scan(spark, small).orderBy(F.desc("spans")).first()
    assert r["base_sha256"] == hashlib.sha256(secrets.joined(base(texts(docs)[r["doc_id"]])).encode()).hexdigest()
    assert secrets.scanned(empty_docs).count() == 0


def test_random_texts_have_the_same_base_spans():
    g = random.Random(5)
    parts = ["password", "PassWD", "token", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGHIJ0123456789", TOKEN, "abc", "-", "é", "K", "ſecret", "secret", "\n", "x1y2z3"]
    for _ in range(3000):
        text = "".join(g.choice(parts) for _ in range(g.randrange(14)))
        assert secrets.base_spans(text) == base(text), repr(text)


def test_layers_are_decoded_to_the_end():
    import base64
    import gzip

    plain = f"password={TOKEN}"
    b64 = base64.b64encode(plain.encode()).decode()
    text = f"see {b64} end"
    assert any(k == "assign" and s == 4 and e <= 4 + len(b64) for k, s, e in secrets.spans(text)[1])
    twice = base64.b64encode(b64.encode()).decode()
    assert any(k == "assign" for k, *_ in secrets.spans(f"x {twice}")[1])
    packed = base64.b64encode(gzip.compress(plain.encode())).decode()
    at = 2
    assert ("assign", at, at + len(packed)) in secrets.spans(f"x {packed}")[1]
    url = "".join(f"%{b:02X}" for b in plain.encode())
    assert ("assign", 2, 2 + len(url)) in secrets.spans(f"x {url} y")[1]
    uni = "".join(f"\\u{ord(c):04x}" for c in plain)
    assert ("assign", 2, 2 + len(uni)) in secrets.spans(f"x {uni}")[1]
    mixed = f"a {url.replace('%3D', '%253D')} b"
    assert any(k == "assign" for k, *_ in secrets.spans(mixed)[1])
    for t in ("%25" * 50, "\\\\u0041" * 9, "A" * 64, base64.b64encode(b"\x1f\x8b\x08broken").decode()):
        secrets.spans(t)  # ends


def test_payloads_at_any_alignment_over_lines_and_in_later_members():
    import base64
    import bz2
    import gzip
    import zlib

    import zstandard

    def seen(text, payload):
        at = text.index(payload)
        return any(k == "assign" and at - 3 <= s and e <= len(text) and s < at + len(payload) for k, s, e in secrets.spans(text)[1])

    secret = f"password={TOKEN}".encode()
    b64 = base64.b64encode(secret).decode()
    for before in ("https://x.example.com/cb/", "a/", "ab/", "abc-", "key_", "x", "xy", "xyz"):
        assert seen(before + b64, b64), before
        assert ("assign", len(before), len(before + b64)) in secrets.spans(before + b64)[1], before
    noise = b"".join(hashlib.sha256(bytes([k])).digest() for k in range(12))
    frame = zstandard.ZstdCompressor().compress
    for name, data in {
        "gzip": gzip.compress(noise) + gzip.compress(secret), "split": gzip.compress(secret[:6]) + gzip.compress(secret[6:]), "zlib": zlib.compress(noise) + zlib.compress(secret), "bzip2": bz2.compress(noise) + bz2.compress(secret),
        "zstd": frame(noise) + frame(secret), "skippable": b"\x50\x2a\x4d\x18\x03\0\0\0abc" + frame(secret), "not UTF-8": b"\xff\xfe\x80" + secret + b"\xff", "mostly binary": noise + b" " + secret + b" " + noise,
    }.items():
        whole = base64.b64encode(data).decode()
        for before in ("", "a/", "cb/"):
            assert seen(before + whole, whole), name
        for width, end in ((76, "\n"), (64, "\r\n"), (11, "\n\t ")):
            lines = end.join(whole[k : k + width] for k in range(0, len(whole), width))
            assert seen(f"see:\n{lines}\nend", lines), (name, width)
    assert secrets.without_secrets(f"a/{b64} b") == "a/[SECRET] b"


def test_redaction_leaves_no_secret(odd_docs, docs):
    for d in (docs, odd_docs):
        out = secrets.redacted(d, chars="n_chars")
        assert out.columns == d.columns and out.count() == d.count()
        assert secrets.scanned(out).where("spans != ''").count() == 0


# Near-duplicates


def brute_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps, threshold=4):
    keys = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold).tolist():
            a, b = i, j
            while keys[a] != a:
                a = keys[a]
            while keys[b] != b:
                b = keys[b]
            keys[max(a, b)] = min(a, b)
    out = []
    for i in range(len(fps)):
        while keys[i] != i:
            i = keys[i]
        out.append(i)
    return out


def test_fingerprints_and_components(spark, small, docs):
    t = texts(docs)
    keys = sorted(t)
    fps = np.array([brute_fingerprint(t[k]) for k in keys], np.uint64)
    roots = brute_components(fps)
    want = {k: (f"{int(f):016x}", keys[r]) for k, f, r in zip(keys, fps, roots, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash_anchors(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [4096, 16])
def test_no_link_within_the_threshold_is_lost(spark, chunk):
    g = np.random.default_rng(1)
    seeds = g.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(s) for s in seeds]
    for s in seeds.tolist():
        for _ in range(12):
            x = s
            for b in g.choice(64, int(g.integers(1, 9)), replace=False).tolist():
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    arr = np.array(fps, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64).tolist()], "fp long")
    labels = {r["node"]: r["label"] for r in simhash.connected(simhash.links(df, chunk=chunk)).collect()}
    groups = collections.defaultdict(set)
    for x, root in zip(arr.view(np.int64).tolist(), brute_components(arr), strict=True):
        groups[root].add(x)
    got = collections.defaultdict(set)
    for x in arr.view(np.int64).tolist():
        got[labels.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_each_word_has_one_home_within_three():
    table, counts_ = simhash.coset_patterns(3)
    assert (counts_ == 1).all() and max(int(x).bit_count() for x in table.ravel().tolist()) == 3
    word = np.array([0b1011001110001111000101])
    anchor = word ^ table[simhash.syndromes(word), 0]
    assert simhash.syndromes(anchor)[0] == 0


def test_simhash_of_odd_documents(odd_docs, empty_docs):
    rows = simhash.components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert simhash.components(empty_docs).count() == 0 and simhash.representatives(empty_docs).count() == 0


def test_documents_without_an_id_and_of_one_id_stay_apart(spark):
    g = random.Random(8)
    prose = lambda: " ".join(f"w{g.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (None, c), (8, d), (8, e), (8, e), (9, d), (None, None), (None, "")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, digest string")
    got = collections.Counter((r["doc_id"], r["text"] or "") for r in simhash.representatives(df).collect())
    assert got == collections.Counter([(None, a), (None, b), (7, c), (8, d), (8, e), (None, "")])


# Surrogates


def surrogate_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, new string, _key string, n int")
    return {r["doc_id"]: r["text"] for r in surrogates.replaced(df).collect()}


def test_surrogates_keep_format_type_and_identity(spark):
    a = "Call +1 (415) 555-2671 or mail Jane.Doe@mail.example.com, card 4111 1111 1111 1111, from 10.20.30.40."
    b = "jane.doe@mail.example.com called from +1 415 555-2671. Mr. John Smith and Mrs. Anna Smith met Mr. Smith; Господин Иванов too. MRS"
    got = surrogate_rows(spark, [(1, a, "", "", 0), (2, b, "", "", 0), (3, "nothing here, version 3.0", "", "", 0), (4, None, "", "", 0), (4, "", "", "", 0)])
    tables = "rows 1 2 3 4 5 6 7 8 9 10 11 12 13 14 and ab4111111111111111cd and 1.2.3 stay"
    assert surrogate_rows(spark, [(1, tables, "", "", 0)])[1] == tables
    assert got[3] == "nothing here, version 3.0" and got[4] in (None, "")
    m = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or mail ([A-Z][a-z]{3}\.[A-Z][a-z]{2}@\S+\.com), card (4\d{3} \d{4} \d{4} \d{4}), from (\d+\.\d+\.\d+\.\d+)\.", got[1])
    assert m, got[1]
    assert (m[1], m[2], m[3]) != ("415", "555", "2671") and m[4].lower() != "jane.doe@mail.example.com"
    digits = [int(c) for c in m[5].replace(" ", "")]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert got[2].startswith(m[4].lower()) and f"+1 {m[1]} {m[2]}-{m[3]}" in got[2]
    n = re.search(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+) met Mr\. (\w+); Господин (\w+) too", got[2])
    assert n and n[2] == n[4] == n[5] and n[1].endswith("rd") and n[3].endswith("na") and re.fullmatch("[А-я]+", n[6])


def test_distinct_entities_have_distinct_surrogates(spark):
    rows = [(i, f"+1 (200) 555-{i:04d} and 1.2.{i // 250}.{i % 250}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    entities = df.select(F.explode(F.regexp_extract_all("text", F.lit(surrogates.ANY), F.lit(0))).alias("entity"))
    found = surrogates.forms(entities)
    news = surrogates.assigned(found, "k").collect()
    assert len(news) == len({(r["type"], r["new"]) for r in news}) == found.select("type", "norm").distinct().count() == 4000
    real = {(r["type"], r["norm"]) for r in news}
    assert not any((r["type"], r["new"]) in real for r in news)


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    real = surrogates.surrogate
    monkeypatch.setattr(surrogates, "surrogate", lambda t, v, s, k, a: F.lit("1.1.1.1") if a == 0 else real(t, v, s, k, a))
    df = spark.createDataFrame([("ip", f"9.9.9.{i}", "") for i in range(5)], "type string, norm string, gender string")
    rows = surrogates.assigned(df, "k").collect()
    assert len({r["new"] for r in rows}) == 5 and sum(r["new"] == "1.1.1.1" for r in rows) == 1


def test_whole_names_of_any_script_go_and_repeated_rows_stay(spark):
    text = "Dr. Martin Luther King met Mr. Νίκος Παπάς and Prof. Արամ Խաչ, then Mr Smith Mrs Jones."
    rows = [(1, text, "", "", 0), (1, text, "", "", 0), (None, text, "", "", 0), (None, text, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, new string, _key string, n int")
    out = [r["text"] for r in surrogates.replaced(df).collect()]
    assert len(out) == 4 and len(set(out)) == 1
    m = re.fullmatch(r"Dr\. (\w+ \w+ \w+) met Mr\. (\w+ \w+) and Prof\. (\w+ \w+), then Mr (\w+) Mrs (\w+)\.", out[0])
    assert m and not any(w in out[0] for w in ("Martin", "Luther", "King", "Νίκος", "Παπάς", "Արամ", "Խաչ", "Smith", "Jones"))
    assert re.fullmatch("[Α-Ωα-ω ]+", m[2]) and re.fullmatch("[Ա-Ֆա-ֆ ]+", m[3])


def test_surrogates_do_not_run_out(spark, monkeypatch):
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", ["ba", "be"])
    names = [("name", f"name{chr(97 + i)}", "male") for i in range(20)]
    emails = [("email", f"{i}@{j}.zz", "") for i in range(10) for j in range(10)]
    df = spark.createDataFrame(names + emails, "type string, norm string, gender string")
    rows = surrogates.assigned(df, "k").collect()
    assert len({r["new"] for r in rows}) == 120 and not {r["new"] for r in rows} & {r["norm"] for r in rows}


def test_surrogates_of_odd_and_real_documents(spark, small, docs, odd_docs, empty_docs):
    assert surrogates.replaced(empty_docs).count() == 0
    out = surrogates.replaced(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    before, after = texts(docs), {r["doc_id"]: r for r in queries.op4_pii_surrogates(spark, small).collect()}
    assert len(after) == len(before)
    any_ = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b")
    everything = " ".join(t or "" for t in before.values())
    real = set(any_.findall(everything))
    for k, r in after.items():
        if not any_.search(before[k] or ""):
            assert r["text"] == before[k]
        assert not real & set(any_.findall(r["text"] or ""))


def test_the_collector_of_cycles_rests_while_texts_are_tokenized(monkeypatch):
    import gc

    from tallywork.llm.queries import tokenizer_path

    words, seen = packing.Words(tokenizer_path()), []
    learn = packing.Words.learn
    monkeypatch.setattr(packing.Words, "learn", lambda self, new: (seen.append(gc.isenabled()), learn(self, new))[1])
    words.ids(["one two three"])
    assert seen == [False] and gc.isenabled()
