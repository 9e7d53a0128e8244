"""Matches with places, validators, detectors, places and recognizers."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import patterns
from spanloom.functions.rex import SLICE, arrow_pass, automaton, quoted, rex, splice, spliced, whole_hits, whole_values
from spanloom.functions.validators import date_ok, iban_ok, iban_valid, luhn_ok, luhn_valid, phone_ok, plausible_date, plausible_phone
from spanloom.operators import detect as D
from spanloom.operators.recognizers import Recognizer


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def found(spark, texts, recognizers=()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(D.detect(docs, recognizers).collect(), key=lambda r: r.doc_id)
    for r in rows:
        for s in r.spans:
            assert s.detector == "labelled_id" or r.text[s.start : s.end] == s.value
            assert s.seq == list(r.spans).index(s)
    return [{(s.entity_type, s.value) for s in r.spans} for r in rows]


@pytest.mark.parametrize("text", ["x😀 a1 bb22 c333 y", "1", "", "none", "a1", "é1日22", "11\n2\n"])
def test_rex_gives_code_point_places(spark, text):
    got = [(m.start, m.end, m.value) for m in one(spark, text, lambda t: rex(t, r"\d+"))]
    assert got == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", text)]


def test_rex_of_null_is_null(spark):
    assert one(spark, None, lambda t: rex(t, r"\d+")) is None


@pytest.mark.parametrize("value", ["+43 660 (x)", "a.b@c.de", "[x]", "$5", "Škoda", r"back\slash", "{a}|^b*"])
def test_quoted_values_match_themselves_as_whole_words(spark, value):
    text = f"n {value} {value}, m"
    assert one(spark, text, lambda t: F.regexp_extract_all(t, F.concat(F.lit("(?U)"), quoted(F.lit(value))), F.lit(0))) == [value, value]
    words = one(spark, "Ann Anna Annab Škoda koda", lambda t: whole_values(t, F.array(F.lit("Ann"), F.lit("Anna"), F.lit("koda"))))
    assert [w.value for w in words] == ["Ann", "Anna", "koda"]


def test_whole_words_are_those_of_an_alternation_longest_first():
    rng = random.Random(2)
    for _ in range(500):
        values = {"".join(rng.choice("ab -_é.") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))}
        text = "".join(rng.choice("ab -_é.") for _ in range(30))
        pattern = r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(values, key=lambda v: (-len(v), v)))) + r")(?!\w)"
        assert list(whole_hits(text, automaton(values))) == [(*m.span(), m[0]) for m in re.finditer(pattern, text)]
    assert list(whole_hits("a", automaton([]))) == [] and one_empty(automaton(["", "a"]))


def test_whole_words_of_few_strings_are_those_of_an_automaton():
    rng = random.Random(3)
    for _ in range(500):
        values = {"".join(rng.choice("ab -_é.") for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(0, 30))}
        text = "".join(rng.choice("ab -_é.") for _ in range(40))
        assert list(whole_hits(text, values)) == list(whole_hits(text, automaton(values)))


def one_empty(strings):
    return list(whole_hits("a a", strings)) == [(0, 1, "a"), (2, 3, "a")]


def test_splice_takes_dollars_and_skips_overlaps(spark):
    edits = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(r).alias("replacement")) for s, e, r in [(4, 6, r"$1\2"), (0, 2, "😀"), (1, 3, "no")]])
    assert one(spark, "abcdefgh", lambda t: splice(t, edits)) == r"😀cd$1\2gh"
    assert one(spark, "", lambda t: splice(t, F.array().cast("array<struct<start:int,end:int,replacement:string>>"))) == ""


def test_validators(spark):
    check = lambda f, v: one(spark, v, f)
    assert check(luhn_valid, "4111 1111-1111 1111") and not check(luhn_valid, "4111111111111112") and not check(luhn_valid, "0000")
    assert check(iban_valid, "gb82 WEST 1234 5698 7654 32") and not check(iban_valid, "GB83WEST12345698765432") and not check(iban_valid, "GB82")
    assert check(plausible_date, "31.12.26") and check(plausible_date, "12/31/2026") and not check(plausible_date, "51.02.538") and check(plausible_date, "March 2026")
    assert check(plausible_phone, "+43 660 1234567")
    assert not any(check(plausible_phone, v) for v in ("2012-2013", "417 (2023) 55", "978-3-16-148410-0", "12 34 5"))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("IP192.168.1.10", ("IP", "192.168.1.10")),
        ("SSN132-65-3444", ("GOV_ID", "132-65-3444")),
        ("MAC Address4e:b8:7f:2f:e4:72", ("MAC", "4e:b8:7f:2f:e4:72")),
        ("IPb524:ed2c:1:2:3:4:5:6", ("IP", "b524:ed2c:1:2:3:4:5:6")),
        ("at fe80::1 now", ("IP", "fe80::1")),
        ("card4111111111111111exp", ("CREDIT_CARD", "4111111111111111")),
        ("IBANGB82WEST12345698765432", ("IBAN", "GB82WEST12345698765432")),
        ("on 2026-03-14T10:30:00.285Z ok", ("DATE", "2026-03-14T10:30:00.285Z")),
        ("the 14th of March 2026", ("DATE", "14th of March 2026")),
        ("Tax ID: AB 123.456.789.", ("GOV_ID", "AB 123.456.789")),
        ("passport number is X1234567", ("GOV_ID", "X1234567")),
        ("invoice #2026-00123", ("ACCOUNT_ID", "2026-00123")),
        ("member no. 7788", ("ACCOUNT_ID", "7788")),
        ("met H.İ. Er", ("PERSON", "H.İ.")),
        ("aged 45, nice", ("AGE", "aged 45")),
        ("at 4 PM", ("TIME", "4 PM")),
        ("P.O. Box 12, 90210-1234", ("ADDRESS", "90210-1234")),
        ("bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", ("CRYPTO", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq")),
        ("flew to Rio de Janeiro", ("LOCATION", "Rio de Janeiro")),
    ],
)
def test_detected(spark, text, expected):
    assert expected in found(spark, [text])[0]


@pytest.mark.parametrize("text", ["it is 3:2 or 10.5", "version 1.2, 3.4", "you may 5 items", "5 years later", "the U.S. and U.K.", "Indiana and Paristown", "10/12 of it", "a@b", "BIC ABCDEFGH12x"])
def test_not_detected(spark, text):
    assert found(spark, [text])[0] == set()


def test_iban_inside_an_iban_is_skipped_and_trailing_words_spoil_it(spark):
    assert [x for x in found(spark, ["GB82WEST12345698765432"])[0] if x[0] == "IBAN"] == [("IBAN", "GB82WEST12345698765432")]
    assert not [x for x in found(spark, ["GB82 WEST 1234 5698 7654 32 OK"])[0] if x[0] == "IBAN"]


def test_null_and_empty_texts_have_no_spans(spark):
    assert found(spark, [None, ""]) == [set(), set()]


def test_detectors_find_what_their_patterns_find(spark):
    """The tests that a text must pass first change nothing."""
    corpus = ["Škoda 12 a.b@ç.de ١٢٣-١٢-١٢٣٤ 123-45-6789", "x" * 30 + " 0x" + "aF" * 20 + " é4e:b8:7f:2f:e4:72", "14 März 2026, 3rd May, may 3rd; 1.2.26 99/99", "Apt. 259, Unit 4B; Suite 709, 48188\n10:30:00 AM", "ab:cd:ef:ab:cd:ef fe80::a SWIFT DEUTDEFF A.B. a.b@c.de https://x"]
    for name, _, _, pattern, _ in patterns.SIMPLE:
        test = D.TESTS.get(name, lambda v: True)
        for text in corpus:
            want = [(m.span(m.re.groups and 1), m[m.re.groups and 1]) for m in re.finditer(pattern, text)]
            got = [((s, e), v) for s, e, _, v, _, _ in D.Detectors(only=[name], places=None)(text)]
            assert got == [(p, v) for p, v in want if test(v)], name


def test_checks_of_one_value_are_those_of_a_column(spark):
    rng = random.Random(1)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    values = ["gb82 WEST 1234 5698 7654 32", "GB82", "4111 1111-1111 1111", "2012-2013", "417 (2023) 55", "978-3-16-148410-0", "+43 660 1234567", "31.12.26", "12/31/2026", "51.02.538", "0.1.26", "March"]
    values += [draw("0123456789", 20) for _ in range(300)] + [draw("0123456789 ()-+.", 20) for _ in range(300)] + [f"{rng.randrange(40)}.{rng.randrange(40)}.{rng.randrange(100):02d}" for _ in range(100)]
    values += [f"GB{rng.randrange(100):02d}WEST{rng.randrange(10**14):014d}" for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", luhn_valid(F.col("v")), iban_valid(F.col("v")), plausible_date(F.col("v")), plausible_phone(F.col("v"))).collect()
    for v, luhn, iban, date, phone in rows:
        assert (luhn, iban, date, phone) == (luhn_ok(v), iban_ok(v), date_ok(v), phone_ok(v)), v


def test_time_grows_with_the_matches_and_no_more():
    text = "u1@mail.example.org 10.1.2.3 Vienna " * 32_000
    detectors = D.Detectors()
    detectors("u1@mail.example.org 1")
    began = time.process_time()
    spans = detectors(text)
    assert len(spans) >= 96_000 and time.process_time() - began < 10
    began = time.process_time()
    assert len(spliced(text, [(s, e, "x") for s, e, *_ in sorted(spans)])) < len(text) and time.process_time() - began < 1


def test_recognizers_see_what_is_around_a_match_and_where_their_group_is(spark):
    rules = [Recognizer("after", r"(?<=ref )(\d+)", "CASE_ID", group=1), Recognizer("last", r"id 1 of (?P<x>1)", "ACCOUNT_ID", group="x"), Recognizer("again", r"(a+)-(a+)", "CASE_ID", group=2)]
    docs = spark.createDataFrame([(0, "ref 77 or id 1 of 1 and a-a 55")], "doc_id long, text string")
    spans = D.detect(docs, rules, only=["none"]).first()["spans"]
    assert [(s.start, s.end, s.value, s.detector) for s in spans] == [(4, 6, "77", "custom:after"), (18, 19, "1", "custom:last"), (26, 27, "a", "custom:again")]


def test_recognizer_groups(spark):
    rules = [Recognizer("tok", r'token = "(?P<v_1>[0-9a-f]+)"', "ACCOUNT_ID", group="v_1"), Recognizer("case", r"ord-\d+", "CASE_ID", 0.5, ignore_case=True), Recognizer("opt", r"k(\d*)!", "CASE_ID", group=1)]
    assert found(spark, ['token = "ab12" ORD-77 k! k5!'], rules)[0] == {("ACCOUNT_ID", "ab12"), ("CASE_ID", "ORD-77"), ("CASE_ID", "5")}


@pytest.mark.parametrize(
    "wrong",
    [
        {"name": "", "pattern": "a", "entity_type": "IP"},
        {"name": "x" * 65, "pattern": "a", "entity_type": "IP"},
        {"name": "a", "pattern": "(", "entity_type": "IP"},
        {"name": "a", "pattern": "x*", "entity_type": "IP"},
        {"name": "a", "pattern": "x", "entity_type": "NOPE"},
        {"name": "a", "pattern": "x", "entity_type": "IP", "confidence": 1.5},
        {"name": "a", "pattern": "x", "entity_type": "IP", "confidence": True},
        {"name": "a", "pattern": "(x)", "entity_type": "IP", "group": True},
        {"name": "a", "pattern": "(x)", "entity_type": "IP", "group": 2},
        {"name": "a", "pattern": "x", "entity_type": "IP", "more": 1},
        {"name": "a", "entity_type": "IP"},
        ["a"],
    ],
)
def test_bad_recognizers_are_refused(wrong):
    with pytest.raises(ValueError):
        Recognizer.from_dict(wrong)


def test_hints_leave_out_no_match():
    """Texts put together from pieces of what detectors look for, also in letters that only (?i) takes for those of the pattern."""
    draw = random.Random(5)
    pieces = (
        "1.2.3.4|10.|2001:db8:0:0:0:0:77:1|::1|fe80::|123-45-6789|12 Baker Street|7b Mill Rd.|Hauptstraße 5|Ringweg 9|SW1A 1AA|, IL 12345|zip code 12345|ZİP 12345|poſtal 54321|Suite 12, 12345|SUITE 7|ſuite 7|fl 3|"
        "bıc: DEUTDEFF|SWIFT DEUTDEFF|4e:b8:7f:00:11:02|[1.5,-2.25]|12.3456, 7.8901|AZ 12 C 34/26|1234/97|A.B.|J.R.R.|14 March 1990|ſep 2020|2020-01-02|3.4.21|May 5|aged 44|44 yearſ old|9-year-old|10:30 PM|9 a.m.|"
        "Patient No: 12345678|lıcenſe 1234|dl 9999|member: AB 123|1|.|:|-| |,|\n|x|A"
    ).split("|")
    plain, hinted = D.Detectors(), D.Detectors()
    plain.may_have = lambda name, text, low: True
    for _ in range(3000):
        text = "".join(draw.choice(pieces) + draw.choice(["", " ", ". "]) for _ in range(draw.randrange(1, 7)))
        assert hinted(text) == plain(text), text


def test_hints_spare_patterns(monkeypatch):
    """A short letter runs few patterns: what its text can't have isn't looked for."""
    letter = "Dr. Anna Keller met Frank Baker. Keller wrote to user1@mail.example.org about card 4000000000000010."
    ran = []
    detectors = D.Detectors()
    monkeypatch.setattr(D, "matches", lambda pattern, text, test=None: ran.append(pattern) or iter(()))
    detectors(letter)
    assert len(ran) < 10


@pytest.mark.parametrize(
    ("text", "cards"),
    [
        ("+1 (836) 555-9331 4913187196670932 53.121.55.90", [("4913187196670932", "card_luhn")]),
        ("4913187196670932 53", [("4913187196670932 53", "card_format")]),
        ("4000 0000 0000 0010 12345", [("4000 0000 0000 0010", "card_luhn")]),
        ("4000 0000 0000 0010-4913187196670932 4111111111111111 12", [("4000 0000 0000 0010", "card_luhn"), ("4913187196670932", "card_luhn"), ("4111111111111111", "card_luhn")]),
        ("12345678901234567890", []),
    ],
)
def test_cards_in_runs_of_digits(text, cards):
    """A number that is whole by itself takes no digits of its neighbours in a run that is too long for one card."""
    got = [(v, name) for _, _, kind, v, _, name in D.Detectors()(text) if kind == "CREDIT_CARD"]
    assert got == cards


def test_a_pass_holds_a_slice_of_a_batch(spark):
    """A pass sees at most SLICE rows at once, in order, whatever the session's batches are; a filter on it runs it no second time."""

    @arrow_pass("long")
    def size(ids):
        return pa.array([len(ids)] * len(ids), pa.int64())

    @arrow_pass("long")
    def same(ids):
        return ids

    rows = spark.range(0, 3 * SLICE + 1, numPartitions=1).select("id", size("id").alias("n"), same("id").alias("same"))
    assert sorted(r["n"] for r in rows.collect()) == [1] + [SLICE] * 3 * SLICE
    assert rows.where("same != id").count() == 0 and rows.where("id < 0").collect() == []


def test_words_that_are_in_no_run_take_no_place():
    from spanloom.functions.lexicon import DEFAULT
    from spanloom.operators import kernel

    words = kernel.words_of("the long road to Anna van der Berg, then dr Zed and so on", DEFAULT)
    assert [w and w.text for w in words] == ["Anna", "van", "der", "Berg", None, "dr", "Zed", None]
    assert [s["value"] for s in kernel.names("we met Anna  Berg, Anna   Cook and Dr.   Zed")] == ["Anna  Berg", "Anna", "Cook", "Zed"]
