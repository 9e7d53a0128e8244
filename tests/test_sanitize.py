"""Overlaps, names, entities, policies, sanitising, vault, leak scan, restore, gateway and modes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions.lexicon import DEFAULT, Lexicon, common_words, learned
from spanloom.operators import gateway, kernel, leakscan, modes, policy, restore, sanitize, tokens, vault
from spanloom.operators.recognizers import Recognizer

MAXIMUM = policy.get_policy("maximum")


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def clean(spark, texts, chosen=MAXIMUM, **options):
    rows = sanitize.sanitize(docs_of(spark, texts), chosen, **options).collect()
    return sorted(rows, key=lambda r: r.doc_id)


def span(s, e, kind, confidence, value=None, detector="d"):
    return {"seq": 0, "start": s, "end": e, "entity_type": kind, "value": value if value is not None else "x" * (e - s), "confidence": confidence, "detector": detector}


def by_place(spans):
    """Overlap resolution once more: every place goes to the best span that wants it, span by span over a map of places."""
    owner, out = {}, []
    ranked = sorted(enumerate(spans), key=lambda p: (-round(p[1]["confidence"] * 10), -(p[1]["end"] - p[1]["start"]), -p[1]["confidence"], p[1]["start"], p[0]))
    for _, s in ranked:
        free = [k for k in range(s["start"], s["end"]) if k not in owner]
        whole = len(free) == s["end"] - s["start"]
        runs = []
        for k in free:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        for run in runs:
            text = s["value"][run[0] - s["start"] : run[-1] + 1 - s["start"]]
            a, b = run[0], run[-1] + 1
            if not whole:
                if len(s["value"]) != s["end"] - s["start"]:
                    continue
                core = text.strip("".join({c for c in text if not c.isalnum()}))
                need = sum(c.isdigit() for c in core) >= 4 if s["entity_type"] in ("PHONE", "CREDIT_CARD") else sum(c.isalnum() for c in core) >= 2
                if not core or not need:
                    continue
                a += text.index(core)
                b = a + len(core)
            for k in range(a, b):
                owner[k] = True
            out.append((a, b, s["entity_type"]))
    return sorted(out)


def test_overlaps_match_a_map_of_places():
    rng = random.Random(1)
    for _ in range(400):
        spans = []
        for _ in range(rng.randrange(1, 8)):
            s = rng.randrange(20)
            e = s + rng.randrange(1, 12)
            value = "".join(rng.choice("ab1 -") for _ in range(e - s - (rng.random() < 0.1)))
            spans.append(span(s, e, rng.choice(["PHONE", "PERSON", "IP"]), rng.choice([0.5, 0.52, 0.55, 0.6, 0.65, 0.85, 0.9]), value))
        assert [(s["start"], s["end"], s["entity_type"]) for s in kernel.resolve_overlaps(spans)] == by_place(spans)


def test_bands_are_half_even():
    kept = kernel.resolve_overlaps([span(0, 4, "IP", 0.85), span(0, 6, "ADDRESS", 0.8)])
    assert [s["entity_type"] for s in kept] == ["ADDRESS"]  # 0.85 is in the band of 0.8


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Ludwig van Beethoven wrote", ["Ludwig van Beethoven"]),
        ("Vincent van der Berg", ["Vincent van der Berg"]),
        ("spoke to Dr. Keller and Mr O'Hara", ["Keller", "O'Hara"]),
        ("Contact: Škoda Łukasz", ["Škoda Łukasz"]),
        ("SMTP AND RFC", []),
        ("The Court said. However it rained", []),
        ("Content is here, the content", []),
        ("Smith's dog", ["Smith"]),
        ("ANNA Müller\nPeter", ["ANNA Müller", "Peter"]),
        ("Anna      Peter", ["Anna", "Peter"]),
        ("Dr.", []),
    ],
)
def test_names(text, expected):
    assert [s["value"] for s in kernel.names(text) if s["entity_type"] == "PERSON"] == expected


def test_organisations_need_a_distinguishing_word():
    orgs = lambda t: [s["value"] for s in kernel.names(t) if s["entity_type"] == "ORGANIZATION"]
    assert orgs("at Vienna General Hospital today") == ["Vienna General Hospital"] and orgs("the European Court ruled") == []
    assert kernel.names("met Zork", Lexicon(non_names=frozenset({"zork"}))) == []


def test_model_spans_win_and_long_texts_go_in_parts(spark):
    text = "Alejandro Martinez\nlives in Graz\n" * 3
    assert "".join(p for _, p in kernel.on_lines(text, 25)) == text and max(len(p) for _, p in kernel.on_lines("x" * 60, 25)) == 25

    def model(t):
        found = re.finditer("Martinez", t)
        return [{"seq": 0, "start": m.start(), "end": m.end(), "entity_type": "LOCATION", "value": m[0], "confidence": 0.85, "detector": "model"} for m in found]

    docs = docs_of(spark, [text]).withColumn("spans", F.array().cast("array<struct<seq:int,start:int,end:int,entity_type:string,value:string,confidence:double,detector:string>>"))
    found = kernel.resolved(docs, provider=model, provider_chars=25).first()["resolved"]
    assert [(s.start, s.entity_type, s.value) for s in found if s.value != "Graz"] == [x for k in range(3) for x in ((33 * k, "PERSON", "Alejandro"), (33 * k + 10, "LOCATION", "Martinez"))]


def test_letter(spark):
    text = "Dr. Anna Keller met Mr Keller in Vienna. Keller wrote to anna.k@x.org and ANNA.K@x.org; Keller's card 4111 1111 1111 1111."
    r = clean(spark, [text])[0]
    assert r.sanitized == (
        "Dr. [[PERSON_001]] met Mr [[PERSON_001]] in [[LOCATION_001]]. [[PERSON_001]] wrote to [[EMAIL_001]] and [[EMAIL_001]]; [[PERSON_001]]'s card [[CREDIT_CARD_001]]."
    )
    assert r.leak.clean and r.num_tokenized == 4 and r.num_redacted == 0
    assert {v.token: v.value for v in r.vault}["[[PERSON_001]]"] == "Anna Keller"
    assert all(a.end <= b.start for a, b in zip(r.edits, r.edits[1:], strict=False))


def test_shared_first_name_gets_a_token_of_its_own(spark):
    r = clean(spark, ["Frank Baker saw Frank Cook. Then Frank's car broke; frank talk"])[0]
    assert r.sanitized == "[[PERSON_001]] saw [[PERSON_002]]. Then [[PERSON_003]]'s car broke; frank talk"


def test_propagation_is_whole_word_and_case_sensitive(spark):
    r = clean(spark, ["Contact: Kurt Weill. Weill and Weillmann and weill, Weill-like"])[0]
    assert r.leak.clean and "weill," in r.sanitized and r.sanitized.startswith("Contact: [[PERSON_001]]. [[PERSON_001]] and ")


def test_null_empty_and_plain_texts(spark):
    a, b, c = clean(spark, [None, "", "nothing to see"])
    assert (a.sanitized, b.sanitized, c.sanitized) == (None, "", "nothing to see") and a.leak.clean and c.edits == []


def test_redaction_isnt_in_the_vault_and_keep_keeps(spark):
    chosen = policy.policy_from_dict({"name": "own", "actions": {"EMAIL": "redact", "IP": "tokenize"}})
    r = clean(spark, ["a@x.org 10.1.2.3 a@x.org Anna Keller"], chosen)[0]
    assert r.sanitized == "[REDACTED] [[IP_001]] [REDACTED] Anna Keller" and r.num_redacted == 1 and [v.token for v in r.vault] == ["[[IP_001]]"]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_dont_depend_on_partitions(spark, parts):
    texts = [f"Anna Keller and u{k}@x.org in Vienna, call +43 660 12345{k:02d}" for k in range(20)]
    rows = sanitize.sanitize(docs_of(spark, texts).repartition(parts), MAXIMUM).select("doc_id", "sanitized").collect()
    assert {r.sanitized for r in rows} == {"[[PERSON_001]] and [[EMAIL_001]] in [[LOCATION_001]], call [[PHONE_001]]"} and len(rows) == 20


def test_registry_gives_one_token_in_all_documents(spark):
    texts = ["Anna Keller wrote", "Boris Novak and ANNA KELLER x", "Frank Baker, Frank Cook and then Frank", "Frank Cook, Frank Stone, Frank too"]
    rows = sanitize.sanitize(docs_of(spark, texts), MAXIMUM, shared_tokens=tokens.registry)
    held = {}
    for v in sanitize.vault_of(rows).collect():
        held.setdefault(v.token, set()).add(v.value.lower())
    assert all(len(values) == 1 for values in held.values())
    assert len(held) == len({next(iter(v)) for v in held.values()})
    one = lambda x: next(t for t, v in held.items() if v == {x})
    out = {r.doc_id: r.sanitized for r in rows.collect()}
    assert one("frank cook") in out[2] and one("frank cook") in out[3] and "Frank" not in out[2] + out[3]


def test_values_of_earlier_documents_are_caught_and_of_later_ones_not(spark):
    texts = ["a weber and Weber", "Dr. Weber came", "a weber and Weber"]
    rows = sanitize.sanitize(docs_of(spark, texts), MAXIMUM, shared_tokens=tokens.registry)
    out = {r.doc_id: (r.sanitized, [v.value for v in r.vault]) for r in rows.collect()}
    assert out == {0: (texts[0], []), 1: ("Dr. [[PERSON_001]] came", ["Weber"]), 2: ("a weber and [[PERSON_001]]", ["Weber"])}


def test_round_trip_of_single_surfaces(spark):
    texts = ["Write a@x.org, then b@y.org or a@x.org.", "Call +43 660 1234567 $5 \\ [x] 10.0.0.1", "no entity", "card 4111111111111111"]
    rows = sanitize.sanitize(docs_of(spark, texts), MAXIMUM)
    back = restore.restore(rows.select("doc_id", F.col("sanitized").alias("response")), sanitize.vault_of(rows))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_custom_recognizer_blocks_what_stays(spark):
    own = policy.Policy("own", {"CASE_ID": "tokenize"}, recognizers=(Recognizer("ord", r"ORD-\d+", "CASE_ID"),))
    assert clean(spark, ["see ORD-12"], own)[0].sanitized == "see [[CASE_ID_001]]"
    rows = spark.createDataFrame([(1, "see ORD-12"), (2, "fine")], "doc_id long, sanitized string")
    got = {r.doc_id: r.leak.clean for r in leakscan.scan(rows, own.recognizers, vault=None).collect()}
    assert got == {1: False, 2: True}


def test_tokens(spark):
    row = spark.range(1).select(
        tokens.make_token(F.lit("PERSON"), F.lit(7)).alias("a"),
        tokens.make_token(F.lit("CASE_ID"), F.lit(1234)).alias("b"),
        tokens.make_token(F.lit("person"), F.lit(1)).alias("c"),
        tokens.make_token(F.lit("IP"), F.lit(0)).alias("d"),
        tokens.parse_token(F.lit("[[CASE_ID_1234]]")).alias("e"),
        tokens.parse_token(F.lit("[[x_1]]")).alias("f"),
        tokens.find_tokens(F.lit("a [[IP_001]] [[no]] [[CASE_ID_002]]")).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f) == ("[[PERSON_007]]", "[[CASE_ID_1234]]", None, None, None)
    assert (row.e.entity_type, row.e["index"]) == ("CASE_ID", 1234) and [m.start for m in row.g] == [2, 20]


def test_policies_are_strict():
    for wrong in ({"actions": {"NOPE": "keep"}}, {"actions": {"IP": "hide"}}, {"default": "x"}, {"more": 1}, {"recognizers": {}}, {"recognizers": [{"name": "a", "pattern": "x", "entity_type": "IP"}]}, []):
        with pytest.raises(ValueError):
            policy.policy_from_dict(wrong)
    with pytest.raises(ValueError, match="choose one of"):
        policy.get_policy("nope")
    registry = policy.Registry()
    registry.register(policy.Policy("mine"))
    for name in ("mine", "maximum"):
        with pytest.raises(ValueError):
            registry.register(policy.Policy(name))
    rule = Recognizer("r", "x1", "EMAIL")
    with pytest.raises(ValueError, match="twice"):
        MAXIMUM.with_recognizers([rule, rule])


def test_vault_is_sealed(spark, tmp_path):
    rows = sanitize.vault_of(sanitize.sanitize(docs_of(spark, ["a@x.org and a@x.org", "10.0.0.1"]), MAXIMUM))
    want = {(r.doc_id, r.token, r.value, len(r.occurrences)) for r in rows.collect()}
    with pytest.raises(ValueError):
        vault.save(rows, f"{tmp_path}/v")
    vault.save(rows, f"{tmp_path}/v", "secret")
    assert {(r.doc_id, r.token, r.value, len(r.occurrences)) for r in vault.load(spark, f"{tmp_path}/v", "secret").collect()} == want
    for phrase in (None, "wrong"):
        with pytest.raises(ValueError):
            vault.load(spark, f"{tmp_path}/v", phrase)
    vault.save(rows, f"{tmp_path}/p", allow_plaintext=True)
    assert vault.load(spark, f"{tmp_path}/p").count() == 2 and vault.merged(rows, rows).count() == 2
    text = vault.envelope({"entries": [1]}, "k", spark)
    assert vault.opened(text, "k", spark)["entries"] == [1]
    with pytest.raises(ValueError):
        vault.opened(text, "other", spark)


def test_gateway_holds_back_leaks_and_never_shows_the_vault(spark):
    seen = spark.sparkContext.accumulator(0)

    def service(text):
        seen.add(1)
        assert "@" not in text
        return text.replace("[[EMAIL_001]]", r"\[\[ EMAIL\_001 ]] [[EMAIL_009]]")

    docs = docs_of(spark, ["mail a@x.org", "nothing", None])
    got = {r.doc_id: r for r in gateway.run(docs, MAXIMUM, service).collect()}
    assert got[0].restored == "mail a@x.org [[EMAIL_009]]" and got[0].invented == ["[[EMAIL_009]]"] and got[1].restored == "nothing" and got[2].restored is None
    assert seen.value == 2
    leaky = gateway.run(docs, policy.Policy("none"), service)
    assert {r.doc_id: r.blocked for r in leaky.collect()} == {0: True, 1: False, 2: False}
    with pytest.raises(gateway.LeakBlocked):
        gateway.run(docs, policy.Policy("none"), service, strict=True)
    assert gateway.dig({"a": [{"b": "c"}]}, "a.0.b") == "c"

def test_gateway_searches_a_document_once_and_writes_no_value(spark, monkeypatch):
    seen, written, write = spark.sparkContext.accumulator(0), [], gateway.materialize

    class Counting(policy.Policy):
        def action_for(self, entity_type):
            seen.add(entity_type == "PERSON")  # once for each search of a text without persons
            return super().action_for(entity_type)

    plain = ["mail a@x.org", "b@y.org and b@y.org", "nothing"]
    assert {r.restored for r in gateway.run(docs_of(spark, plain), Counting("all", {}, "tokenize")).collect()} == set(plain)
    assert seen.value == len(plain)
    monkeypatch.setattr(gateway, "materialize", lambda df: written.append(write(df)) or written[-1])
    texts = ["Dr. Anna Kellér met Zoë Baker. Kellér wrote to ünï@x.org, a@x.org", "", None, "Ärzte: b@y.org 𝒳 b@y.org und B@y.org", "nothing"]
    rows = {r.doc_id: r for r in gateway.run(docs_of(spark, texts), MAXIMUM).collect()}
    want = {r.doc_id: r for r in sanitize.sanitize(docs_of(spark, texts), MAXIMUM).collect()}
    for k, t in enumerate(texts):
        assert rows[k].text == t and rows[k].sanitized == want[k].sanitized == rows[k].response and not rows[k].dropped
        assert sorted(rows[k].restored_tokens) == sorted(v.token for v in want[k].vault)
    assert "Kellér" not in str(written[0].collect()) and "y.org" not in str(written[0].collect())
    two = spark.createDataFrame([(7, "mail a@x.org"), (7, "b@y.org wrote"), (None, "c@z.org")], "doc_id long, text string")
    assert sorted(r.restored for r in gateway.run(two, MAXIMUM).collect()) == ["b@y.org wrote", "c@z.org", "mail a@x.org"]


def test_modes_of_sanitized_rows_equal_those_of_their_spans(spark):
    texts = ["Dr. Anna Kellér met Zoë Baker on 3 May 2011. Kellér wrote to ünï@x.org", "", None, "nothing"]
    for p in (MAXIMUM, policy.Policy("mixed", {"PERSON": "redact", "EMAIL": "tokenize"})):
        made = sanitize.sanitize(docs_of(spark, texts), p, run_leak_scan=False)
        for mode in modes.MODES:
            want = {r.doc_id: r.text for r in modes.rendered(docs_of(spark, texts), modes.spans_of(made), mode).collect()}
            rows = modes.rendered_rows(made, mode)
            assert {r.doc_id: r.text for r in rows.collect()} == want
            assert "Join" not in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan


def test_modes_in_one_pass_equal_those_of_sanitized_rows(spark):
    people = " ".join(f"Then {a} {b} left." for a in ("Ana", "Zoë", "Frank", "Lea") for b in ("Kellér", "Baker", "Ødegård")) + " Frank called Baker."
    texts = [
        people,
        "Dr. Anna Kellér met Zoë Baker on 3 May 2011 and 1/2/11. Kellér wrote to a@x.org, A@X.org, b@y.org; 1 22 5559331 44",
        "12 Main Street, 10.0.0.1, 00:1b:44:11:3a:b7, 48.2082, 16.3738, card 4111 1111 1111 1111, aged 44, 14:30, https://x.org/a, patient 12345 in Vienna",
        "born 2 March 1970\x1c\x85 or 3\u00a0May 1999², 𝒳 2011-05-03 Graz General Hospital, DE89 3704 0044 0532 0130 00",
        "",
        None,
        "nothing",
    ]

    def model(t):
        found = re.finditer("left|met [A-Z]", t)
        return [{"seq": 0, "start": m.start(), "end": m.end(), "entity_type": "Odd_kind" if len(m[0]) < 5 else "DOB", "value": m[0], "confidence": 0.9, "detector": "model"} for m in found]

    mixed = policy.Policy("mixed", {"PERSON": "redact", "EMAIL": "tokenize", "DATE": "tokenize"})
    for p, options in ((MAXIMUM, {"provider": model}), (mixed, {})):
        made = sanitize.sanitize(docs_of(spark, texts), p, run_leak_scan=False, **options).persist()
        for mode in modes.MODES:
            want = {r.doc_id: r.text for r in modes.rendered_rows(made, mode).collect()}
            rows = modes.in_mode(docs_of(spark, texts), p, mode, **options)
            assert {r.doc_id: r.text for r in rows.collect()} == want
            assert rows._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
        want = sorted(modes.mapping(modes.spans_of(made), "synthetic").collect())
        assert sorted(modes.mapping_in_mode(docs_of(spark, texts), p, "synthetic", **options).collect()) == want and len(want) > 2
        made.unpersist()
    for call in (modes.in_mode, modes.mapping_in_mode):
        with pytest.raises(ValueError):
            call(docs_of(spark, texts), MAXIMUM, "nope")


def test_overrides_keep_and_tag(spark):
    docs = docs_of(spark, ["mail a@x.org and b@y.org about Zed"])
    spans = modes.spans_of(sanitize.sanitize(docs, policy.get_policy("personal"), use_names=False))
    says = spark.createDataFrame([(0, 5, 12, "EMAIL", "a@x.org", True), (0, 31, 34, "PERSON", "Zed", False)], "doc_id long, start int, end int, entity_type string, value string, kept boolean")
    out = modes.rendered(docs, modes.with_overrides(spans, says), "semantic").first()["text"]
    assert out == "mail a@x.org and [[EMAIL_002]] about [[PERSON_001]]"
    with pytest.raises(ValueError):
        modes.rendered(docs, spans, "nope")
    assert modes.keep_uncertain(spans).count() == 2


def test_a_corpus_says_which_words_are_no_names(spark):
    texts = ["the applicant said, Anna met the applicant", "our applicant, Anna, saw an applicant", "an applicant and Anna; one Applicant", "x Anna Zork, Zork"]
    rows = {r.word: (r.n, r.lower) for r in common_words(docs_of(spark, [*texts, None, ""]), least=3).collect()}
    assert rows["applicant"] == (6, 5) and "anna" not in rows and "zork" not in rows
    own = learned(docs_of(spark, texts), least=3)
    assert "applicant" in own.non_names and DEFAULT.non_names < own.non_names
    assert [s["value"] for s in kernel.names("met Applicant Keller")] == ["Applicant Keller"]
    assert [s["value"] for s in kernel.names("met Applicant Keller", own)] == ["Keller"]


def test_a_token_with_several_values_restores_none_of_them(spark):
    replies = spark.createDataFrame([(0, "Dear [[PERSON_001]] and [[PERSON_002]]")], "doc_id long, response string")
    rows = [(0, "[[PERSON_001]]", "Anna"), (0, "[[PERSON_001]]", "Boris"), (0, "[[PERSON_002]]", "Carla"), (0, "[[PERSON_002]]", "Carla")]
    row = restore.restore(replies, spark.createDataFrame(rows, "doc_id long, token string, value string")).first()
    assert (row.text, row.restored, row.invented) == ("Dear [[PERSON_001]] and Carla", ["[[PERSON_002]]"], ["[[PERSON_001]]"])


def test_the_first_vault_keeps_its_value(spark):
    make = lambda value, at: spark.createDataFrame([(0, "[[PERSON_001]]", "PERSON", value, "tokenize", [(at, at + 2)])], vault.ROW_SQL)
    row = vault.merged(make("Zoe", 5), make("Anna", 9), make("Zoe", 5)).first()
    assert row.value == "Zoe" and [(o.start, o.end) for o in row.occurrences] == [(5, 7), (9, 11)]


def test_plans_of_a_vault_dont_show_the_key(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(0, "[[PERSON_001]]", "PERSON", "Zoe", "tokenize", [(1, 3)])], vault.ROW_SQL)
    key = vault._key("secret", b"0" * 16)
    made = vault._with_key(rows, key)._jdf.queryExecution().toString()
    assert key.hex() not in made.lower()


def test_a_common_first_word_brings_no_candidates(spark):
    texts = ["Contact: Anna Keller and Anna Novak"] + ["the word Anna, then Anna Novak"] * 3 + ["Contact: Anna Larsen, with Anna Keller"]
    docs = docs_of(spark, texts)
    held = spark.createDataFrame([(0, "Anna Keller", 1, "[[PERSON_001]]"), (0, "Anna Novak", 2, "[[PERSON_002]]"), (4, "Anna Larsen", 1, "[[PERSON_003]]")], "doc_id long, canonical string, first int, replacement string")
    rows = {(r.doc_id, r.surface) for r in sanitize.earlier_values(docs, held).collect()}
    assert rows == {(1, "Anna Novak"), (2, "Anna Novak"), (3, "Anna Novak"), (4, "Anna Keller")}


def test_documents_that_share_tokens_do_so_in_order(spark):
    texts = ["Contact: Anna Keller, a@x.org", "mail A@X.ORG now", "saw Anna Keller", None, "Contact: Boris Stone and Boris Weber. Boris left", "Boris came"]
    rows = clean(spark, texts, shared_tokens=tokens.registry)
    assert [r.sanitized for r in rows] == [
        "Contact: [[PERSON_001]], [[EMAIL_001]]",
        "mail [[EMAIL_001]] now",
        "saw [[PERSON_001]]",
        None,
        "Contact: [[PERSON_002]] and [[PERSON_003]]. [[PERSON_004]] left",
        "[[PERSON_004]] came",
    ]
    assert all(r.leak.clean for r in rows)


def test_a_redacted_type_never_comes_back_from_the_sweep(spark):
    chosen = policy.policy_from_dict({"name": "own", "actions": {"PERSON": "redact", "EMAIL": "tokenize"}})
    r = clean(spark, ["Frank Baker saw Frank Cook. Frank wrote to f@x.org, f@x.org"], chosen)[0]
    assert r.sanitized == "[REDACTED] saw [REDACTED]. [REDACTED] wrote to [[EMAIL_001]], [[EMAIL_001]]" and [v.token for v in r.vault] == ["[[EMAIL_001]]"]


def test_sanitising_shuffles_nothing(spark):
    plan = sanitize.sanitize(docs_of(spark, ["Anna"]), MAXIMUM)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("place", [(0, 0), (-1, 2), (1, 99), (2, 1)])
def test_spans_of_a_model_must_be_in_their_text(place):
    with pytest.raises(ValueError):
        kernel.asked(lambda t: [span(*place, "PERSON", 0.9, "x")], "short", 100)
