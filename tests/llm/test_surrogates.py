"""Surrogates against a second finder in Python, and what must hold between all entities of a corpus."""

import collections
import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from tallywork.llm import surrogates

COLUMNS = "doc_id long, text string, new string, of_row string, parts int"


def replaced(spark, texts):
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], COLUMNS)
    out = surrogates.replaced(df, count="n").collect()
    assert len(out) == len(texts)
    return [r["text"] for r in sorted(out, key=lambda r: r["doc_id"])], [r["n"] for r in sorted(out, key=lambda r: r["doc_id"])]


def valid_iban(t):
    t = t.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def an_iban(g, land="DE"):
    body = "".join(g.choice("0123456789") for _ in range(18))
    number = int("".join(str(int(c, 36)) for c in body + land) + "00")
    return f"{land}{98 - number % 97:02d}{body}"


def test_texts_are_cut_where_a_second_finder_cuts_them(spark):
    g = random.Random(9)
    first, last = ["John", "Anna", "Νίκος", "Иван", "O'Neil"], ["Smith", "Jones", "Παπάς", "Иванов", "Smith-Jones"]
    makers = [
        lambda: f"{g.choice('abcd')}{g.randrange(30)}.x@{g.choice(['a.co', 'mail.example.com', 'e.org'])}", lambda: f"10.{g.randrange(3)}.{g.randrange(5)}.{g.randrange(250)}", lambda: f"+1 (415) 555-{g.randrange(50):04d}", lambda: f"415 555 {g.randrange(50):04d}",
        lambda: f"{g.randrange(100, 130)}-45-{g.randrange(20):04d}", lambda: an_iban(random.Random(g.randrange(20))), lambda: f"{g.choice(['Mr.', 'Mrs', 'Dr.', 'Prof', 'Herr'])} {g.choice(first)} {g.choice(last)}", lambda: f"my name is {g.choice(first)}", lambda: f"2001:db8::{g.randrange(40):x}",
        lambda: f"4111 1111 1111 {g.randrange(30):04d}",
    ]
    words = ["the", "of", "12", "v1.2", "x=3", "é", "中文", "\n", "a@b", "::", "\u0001", "Dr.", "2026-01-02", "1,000,000"]
    apart = " ¦ "
    texts = [apart.join(g.choice(makers)() if g.random() < 0.3 else g.choice(words) for _ in range(g.randrange(40))) for _ in range(300)]
    new, counts = replaced(spark, texts)
    pattern = regex.compile(surrogates.ANY)
    images = collections.defaultdict(set)
    for before, after, n in zip(texts, new, counts, strict=True):
        assert len(pattern.findall(before)) == n
        for x, y in zip(before.split(apart), after.split(apart), strict=True):
            if found := pattern.search(x):
                assert y.startswith(x[: found.start()]) and y.endswith(x[found.end() :])
                images[found[0]].add(y[found.start() : len(y) - (len(x) - found.end())])
            else:
                assert x == y
    assert len(images) > 150 and all(len(x) == 1 for x in images.values())
    shape = lambda e: regex.sub(r"^\p{L}+\.? |[^\w@.:]", "", e).lower()
    by_person = lambda e: regex.sub(r"^(?:my name is|\p{L}+\.?) ", "", e)
    numbers = {e: next(iter(x)) for e, x in images.items() if not regex.match(r"[\p{L}]+\.? ", e)}
    assert len({shape(x) for x in numbers.values()}) == len({shape(e) for e in numbers})
    assert not {shape(x) for x in numbers.values()} & {shape(e) for e in numbers}
    people = {e: next(iter(x)) for e, x in images.items() if regex.match(r"[\p{L}]+\.? ", e)}
    assert len({by_person(x) for x in people.values()}) >= len({by_person(e) for e in people})
    for e, x in numbers.items():
        if e.startswith("DE"):
            assert valid_iban(e) and valid_iban(x) and x[:2] == "DE" and len(x) == len(e)


def test_a_person_is_one_under_all_titles(spark):
    texts = ["Mr John Smith spoke.", "Dr John Smith spoke.", "Prof. John Smith", "Mrs Anna Smith and Dr Anna Smith", "Mr Kim Lee, Mrs Kim Lee, Dr Kim Lee", "Mr Smith", "DR JOHN", "My name is John Smith."]
    new, _ = replaced(spark, texts)
    john = new[0].removeprefix("Mr ").removesuffix(" spoke.")
    assert new[1] == f"Dr {john} spoke." and new[2] == f"Prof. {john}" and john.split()[0].endswith("rd") and new[7] == f"My name is {john}."
    anna = regex.fullmatch(r"Mrs (\w+) (\w+) and Dr (\w+) (\w+)", new[3])
    assert anna[1] == anna[3] and anna[1].endswith("na") and anna[2] == anna[4] == john.split()[1] == new[5].split()[1]
    kim = regex.fullmatch(r"Mr (\w+) (\w+), Mrs (\w+) (\w+), Dr (\w+) (\w+)", new[4])
    assert len({kim[1], kim[3], kim[5]}) == 3 and kim[2] == kim[4] == kim[6]


@pytest.mark.parametrize("title, name, script", [("Господин", "Иван Петров", "Cyrillic"), ("Dr.", "Νίκος Παπάς", "Greek"), ("Prof.", "Արամ Խաչատրյան", "Armenian"), ("السيد", "محمد", "Arabic"), ("श्रीमती", "राधा", "Devanagari"), ("גברת", "שרה", "Hebrew"), ("ქალბატონი", "ნინო", "Georgian"), ("Mr", "José Müller", "Latin")])
def test_names_stay_in_their_script(spark, title, name, script):
    (new,), (n,) = replaced(spark, [f"{title} {name}, 12"])
    words = new.removeprefix(f"{title} ").removesuffix(", 12").split(" ")
    assert n == 1 and len(words) == len(name.split(" ")) and all(regex.fullmatch(rf"[\p{{{script}}}\p{{M}}]+", w) for w in words) and name not in new


def test_surrogates_end_where_their_space_is_full(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "LONGER", 2)
    mail = [f"{k}@{s}.co" for k, s in [*((k, "a") for k in range(6)), *((k, "e") for k in range(5))]]
    new, _ = replaced(spark, [" ".join(mail), *(f"{k:03d}-00-0000" for k in range(30))])
    assert len(set(new[0].split(" "))) == 11 and not set(mail) & set(new[0].split(" "))
    short = spark.createDataFrame([("phone", str(k), "") for k in range(10)], "type string, norm string, gender string")
    rows = surrogates.assigned(short, "k").collect()
    assert len({r["new"] for r in rows}) == 10 and not {r["new"] for r in rows} & {str(k) for k in range(10)}


def test_long_texts_take_linear_time(spark):
    n = 40_000
    texts = ["a." * n, "a" * n, "Dr" + " Aa" * n, "x@" + "a." * n + "a", "1 " * n, "a@" * n, " ".join(f"u{k}@a.example.com" for k in range(5_000)), "AB12" * n]
    began = time.perf_counter()
    new, counts = replaced(spark, texts)
    assert time.perf_counter() - began < 120 and counts[6] == 5_000 and len(set(new[6].split(" "))) == 5_000
    assert counts[2] == 1 and counts[3] == 1


def test_addresses_of_version_six_are_one_however_written(spark):
    (new,), (n,) = replaced(spark, ["2001:DB8::1 and 2001:0db8:0:0:0:0:0:1, fe80::a; std::vector, 12::30"])
    a, b = regex.match(r"(\S+) and (\S+),", new).groups()
    assert n == 3 and a == b != "2001:db8::1" and new.endswith("std::vector, 12::30")
    assert surrogates.IPV6 in surrogates.ANY and spark.range(1).select(surrogates.expanded(F.lit("2001:db8::1"))).first()[0] == "2001:0db8:0000:0000:0000:0000:0000:0001"
