"""Operators that judge each text alone: rules, scores, token ids."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from spanloom.llm import binpack, bpe, catalogue, common, line_crf, line_quality, packing, toxicity, url_filter, word_ids

SCHEMA = "doc_id long, text string, lang string, words string, id string, h long"
ODD = [None, "", " ", "\n\t", "a", "ÄÖ é ß x", "日本語。テスト", "x" * 5000, "ab " * 3000, "don't 'tis ΑΣ ΣΑΣ. İI ﬁ 12 3a'll\r\n\nq", "<|endoftext|> a", "é ́x a\u0085b\x1cc"]


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k if ids is None else ids[k], t, None, "w", "i", 1) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_gives_the_librarys_ids_and_decodes_them(spark, known):
    rng = random.Random(3)
    texts = [*ODD, "".join(rng.choice("abcdefgh") for _ in range(3000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(2000)), "a" * 1500]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    raw = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs)).collect()}
    for k, t in enumerate(texts):
        want = known.encode_ordinary(t or "")
        assert ids[k] == want and raw[k] == (t or "").encode()
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_replays_lower_ranks_that_a_merge_opens():
    # abc ranks before ab, so the pair that a merge of bc opens must come before the second bc of the word.
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"cb": 299, b"bcb": 262}
    known = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    words = ["abcbc", "bcbcbc", "abcabc", "cbcb", "bcbabcb", "aabbcc"]
    assert bpe.MergeReplay(ranks).encode([w.encode() for w in words]) == [known.encode_ordinary(w) for w in words]


def test_bpe_forgets_when_it_knows_too_much_and_keeps_texts_over_blocks_whole(spark, known):
    texts = [*ODD, "one two three four", "five six one two", "seven", "日本 語。 テ スト x", "ö ö　 ä b  c 'sé 's 's. x'.s"]
    for block, most in ((1, 3), (40, 5), (4000, 10**6)):
        got = {r.doc_id: r.ids for r in bpe.encode(frame(spark, texts), block=block, known=most).collect()}
        assert got == {k: known.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_bpe_of_an_empty_table_and_of_repeated_rows_without_ids(spark, known):
    assert bpe.digests(frame(spark, []).where("doc_id is not null")).collect() == []
    rows = bpe.digests(frame(spark, ["a b", "a b", None, ""], [None, None, 3, 3])).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (0, 2), (3, 0), (3, 0)]


def test_word_ids_are_the_tokenizers():
    path = public_tokenizers.path(word_ids.VOCABULARY)
    tokenizer, own = Tokenizer.from_file(path), word_ids.WordIds(path, known=12)
    for text, (ids, ends) in zip([*ODD, *ODD], own.encode([*ODD, *ODD]), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, word_ids.END]
        assert ends[-1] == len(ids) and (np.diff(ends) > 0).all()


def test_word_ids_hold_the_arrays_of_a_small_block():
    own, texts = word_ids.WordIds(public_tokenizers.path(word_ids.VOCABULARY)), pa.array(["The cat sat on a mat, again. " * 70] * 2000)
    tracemalloc.start()
    try:
        assert sum(len(ids) for ids, _ in own.encode(texts)) > 1_000_000
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_a_worker_drops_the_caches_of_another_operator():
    def batches(them):
        kept["own"] = 1
        yield from them

    def others(them):
        yield from them

    kept, others.__module__ = common.worker_cache(), "another"
    try:
        assert list(common.tidy(batches)([])) == list(common.tidy(batches)([])) == [] and kept
        assert list(common.tidy(others)([])) == [] and not kept
    finally:
        common._CACHES.pop()


def pieces_hold(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(word_ids.VOCABULARY))
    want = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for k, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[k]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(want[k][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[k])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_both_packings_place_every_id_once(spark, capacity):
    rng = random.Random(capacity)
    texts = [*ODD, *[" ".join(rng.choice(["The", "cat.", "sat!", "12", "on", "it\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]]
    docs = frame(spark, texts)
    pieces_hold(packing.pack(docs, capacity=capacity, block=200).collect(), texts, capacity)
    by_sequence = pieces_hold(binpack.pack(docs, capacity=capacity).collect(), texts, capacity)
    total = sum(n for parts in by_sequence.values() for _, n in parts)
    assert len(by_sequence) <= -(-total // capacity) * 1.2 + 1


def test_packed_matrices_give_the_ids_back(spark):
    texts = ["One two.", "", "Three four five six seven. Eight!", None, "nine " * 40]
    packed = binpack.pack(frame(spark, texts), capacity=16, keep_ids=True)
    ids = {}
    for r in binpack.matrices(packed, 16).collect():
        row, cuts, places = (np.frombuffer(bytes(x), "<u4") for x in (r.input_ids, r.cu_seqlens, r.position_ids))
        assert len(row) == len(places) == 16 and cuts[0] == 0
        for s, e in zip(cuts, cuts[1:], strict=False):
            assert places[s:e].tolist() == list(range(e - s))
        ids[r.sequence_id] = row
    for r in packed.collect():
        assert ids[r.sequence_id][r.offset : r.offset + r.length].tolist() == np.frombuffer(bytes(r.ids), "<u4").tolist()


def test_the_registered_packing_builds_the_matrices_of_all_documents(spark, tmp_path):
    texts = [*ODD, *["word of %d " % k * (k * 11 % 130) for k in range(150)], "long text " * 5000]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, found, used = Tokenizer.from_file(public_tokenizers.path(word_ids.VOCABULARY)), {}, 0
    for r in catalogue.queries()["op2_best_fit_packing"](spark, str(tmp_path)).collect():
        row, cuts, places = (np.frombuffer(bytes(x), "<u4") for x in (r.input_ids, r.cu_seqlens, r.position_ids))
        assert len(row) == len(places) == binpack.CAPACITY and len(cuts) == len(r.doc_ids) + 1 == len(r.starts) + 1
        assert not row[cuts[-1] :].any() and not places[cuts[-1] :].any()
        for s, e, doc, start in zip(cuts, cuts[1:], r.doc_ids, r.starts, strict=False):
            assert places[s:e].tolist() == list(range(e - s))
            found.setdefault(doc, []).append((start, row[s:e].tolist()))
        used += int(cuts[-1])
    got = {k: [x for _, part in sorted(parts) for x in part] for k, parts in found.items()}
    assert got == {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    assert used == sum(map(len, got.values()))


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([1, 7, 10, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(40))), reverse=True)
        bins: list[int] = []
        for n in items:
            fits = [k for k, used in enumerate(bins) if used + n <= capacity]
            if fits:
                bins[max(fits, key=lambda k: bins[k])] += n
            else:
                bins.append(n)
        got: dict[int, int] = {}
        for n, a, b, each, first, offset in binpack.plan({n: items.count(n) for n in items}, capacity):
            for k in range(b - a):
                s = first + k // each
                assert got.get(s, 0) == offset + k % each * n
                got[s] = got.get(s, 0) + n
        assert sorted(got.values()) == sorted(bins)


def test_cuts_cost_least():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.randint(4, 12)
        ends = np.cumsum([rng.randint(1, min(4, capacity)) for _ in range(rng.randint(1, 14))]).tolist()
        penalty = [rng.randint(0, 5) for _ in ends]
        best = {0: 0}
        for k, e in enumerate(ends):
            best[e] = min(best[j] + capacity - (e - j) for j in best if e - j <= capacity) + penalty[k]
        cuts = packing.best_cuts(ends, penalty, capacity)
        spent = sum(capacity - (b - a) for a, b in zip([0, *cuts], cuts, strict=False)) + sum(penalty[ends.index(c)] for c in cuts)
        assert cuts[-1] == ends[-1] and spent == best[ends[-1]]
    assert packing.powers_of_two(3000) == [2048, 512, 256, 128, 32, 16, 8]


def brute_quality(text):
    words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_base_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [*ODD[:7], *["".join(rng.choice(["a ", "b ", "c\n", "d\t", "# ", "é\x0b", "\x1c"]) for _ in range(rng.randrange(120))) for _ in range(60)]]
    got = {r.doc_id: r for r in line_quality.op3(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_line_rules_remove_furniture_and_keep_prose(spark):
    prose = " ".join(f"Word{k} and other{k}." for k in range(40))
    texts = [prose, prose + "\nHome | News | Sport | Weather | Contact\nAll rights reserved.", " ".join(f"w{k}***" for k in range(80)), "\n".join(f"Home{k} | News | Sport | Weather" for k in range(30))]
    got = {r.doc_id: r for r in line_quality.measured(frame(spark, texts), ["lang"]).collect()}
    assert [got[k].kept for k in range(4)] == [True, True, False, False]
    assert got[1].clean_text == prose and got[1].n_failed_lines == 2 and got[0].clean_text == prose


def test_url_rules(spark):
    urls = ["https://A.Example.COM/en/1?x", "http://www.example.com/en/2", "http://x.net/es/", "net", None, "http://com", "ftp://a.net/fr/1#t", "http://notcom/x", "http://b.com/y?a/b", "://com/z"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.op1(pages).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (got[1].rule, got[1].verdict) == ("www.example.com/en/", "allow")
    assert [got[k].rule for k in (2, 3, 4, 5, 6, 7, 8, 9)] == ["net/es/", None, None, None, "net/fr/", None, "com/", "com/"]
    assert (got[3].host, got[4].path, got[5].host, got[5].path, got[8].path) == ("", "", "com", "", "/y")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.op1(pages.limit(0)).collect() == []


def test_url_probabilities_sum_to_one_and_tell_classes_apart(spark):
    counts = np.bincount(np.concatenate([url_filter.grams([t])[0] for t in ["good.com/a", "good.org/b"]]), minlength=url_filter.SYMBOLS**4)
    p = np.exp(url_filter.log_probabilities(counts)).reshape(-1, url_filter.SYMBOLS).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)
    rows = [(f"news{k}.site/story/{k}", "allow") for k in range(60)] + [(f"win-casino{k}.bad/xx{k}", "block") for k in range(60)]
    model = url_filter.fit(spark.createDataFrame(rows, "text string, verdict string"))
    good, bad = url_filter.score(["news99.site/story/7", "win-casino99.bad/xx7"], model.ratio)
    assert good > model.threshold > bad


def test_levenshtein_automaton_and_trie():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        for edits in (1, 2):
            automaton = toxicity.Levenshtein(a, edits)
            state = automaton.start()
            for c in b:
                state = automaton.step(state, c)
            d = distance(a, b)
            assert automaton.accepts(state) == (d if d <= edits else None), (a, b, edits)
    lexicon = toxicity.Lexicon({"stupid": 2.0, "scum": 2.0, "réeux*": 1.0})
    hit = {w: lexicon.match(w) for w in ("stupid", "stupd", "stuqid", "sstupid", "stpd", "scum", "scun", "réeuxment", "réeu")}
    assert hit["stupid"] == (2.0, 0) and hit["stupd"][1] == hit["stuqid"][1] == hit["sstupid"][1] == 1 and hit["réeuxment"] == (1.0, 0)
    assert hit["stpd"] is hit["scun"] is hit["réeu"] is None
    assert all(lexicon.possible(w) for w, h in hit.items() if h)


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon({"stupid": 2.0})
    plain, quoted, mentioned, leet = (toxicity.features(t, lexicon)[0] for t in ("you are stupid today", 'the word "stupid" is rude', "she said stupid things", "you $tup1d"))
    assert plain == leet == 2.0 and quoted < plain and mentioned < plain
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == (0.0, 0.0, 0.0)


def labelled(spark, make, label):
    rows = [(k, make(k), k % 2) for k in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, None), (1000, "", "y"), (1000, "", "y")], "doc_id long, text string, score string")
    other = "toxic" if label == "quality" else "quality"
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 1)], f"doc_id long, {label} int, {other} int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_learns_and_finds_misspellings(spark):
    docs, labels, truth = labelled(spark, lambda k: f"some w{k} text v{k} here and " + (f"you worthless {'fool' if k % 4 == 1 else 'clown'} {k}" if k % 2 else f"fine day number {k}"), "toxic")
    got = {r.doc_id: r for r in toxicity.op7(docs, labels).collect()}
    assert len(got) == 402 and all(got[i].predicted == y for i, y in truth.items())
    assert got[0].held_out == (zlib.crc32(b"0") % 5 == 0) and 0 <= got[None].score < 0.5 and got[1000].predicted == 0
    model = toxicity.fit(docs, labels)
    lexicon = toxicity.Lexicon(model.terms)
    assert model.score("you worthles person", lexicon) > 0.5 > model.score("a fine day", lexicon)
    assert toxicity.op7(docs.limit(0), labels).collect() == [] and toxicity.op7(docs, labels.limit(0)).count() == 403


def test_quality_field_learns_lines(spark):
    good = lambda k: "\n".join(f"This is a plain sentence number {k} with words {j}." for j in range(4))
    bad = lambda k: "\n".join(f"buy### now$$$ {k} *** | | {j} !!!" for j in range(4))
    docs, labels, truth = labelled(spark, lambda k: good(k) if k % 2 else bad(k), "quality")
    got = {r.doc_id: r for r in line_crf.op10(docs, labels).collect()}
    assert all(got[i].predicted == y for i, y in truth.items()) and all(0 <= r.score <= 1 for r in got.values())
    assert got[None].held_out and line_crf.op10(docs.limit(0), labels).collect() == []
    assert line_crf.op10(docs, labels.limit(0)).count() == 403


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    x, emission, move = rng.normal(size=(5, line_crf.WIDTH)), rng.normal(size=line_crf.WIDTH), rng.normal(size=(2, 2))
    weight, good = 0.0, np.zeros(5)
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        w = np.exp(sum(x[k] @ emission * y[k] for k in range(5)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        weight += w
        good += w * np.array(y)
    assert np.allclose(line_crf.marginals(x @ emission, move), good / weight)


def test_scores_of_a_long_text_dont_need_its_features_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    emission, text = rng.normal(size=line_crf.WIDTH), "\n".join(["A line here.", "", " ", "nav | nav | nav", "more words!!", "é"] * 7) + "\n"
    want, sizes = line_crf.sequence(text)
    for block in (1, 3, 4096):
        monkeypatch.setattr(line_crf, "SCORED_LINES", block)
        z, n = line_crf.potentials(text, emission)
        assert np.allclose(z, want @ emission) and n.tolist() == sizes.tolist()
    assert [len(x) for x in line_crf.potentials(None, emission)] == [0, 0]


def test_texts_of_many_lines_train_whole(spark):
    texts = ["good words here now.\n" * 450, "bad | bad | bad\n" * 450] * 12
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(len(texts))], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in line_crf.op10(docs, labels).collect()}
    assert min(scores[k] for k in range(0, 24, 2)) > 0.5 > max(scores[k] for k in range(1, 24, 2))


def test_repeated_ids_dont_raise_the_bound_of_a_sample(spark):
    from spanloom.llm.common import labelled_sample

    docs = frame(spark, ["a", "b", "c", "d"] * 20, [1, 2, 3, 4] * 20)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 1).collect()
    assert len(rows) <= 2 and len({r.i for r in rows}) == len(rows)


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("you’re so vile, aren’t you", False),
        ("you're so vile, aren't you", False),
        ("he said “so vile” to her", True),
        ("he said 'x' ‘so vile!’ to her", True),
        ('he said "oh" and so vile "oh" to her', False),
        ('the "vile" one', True),
        ("students’ vile rules", False),
    ],
)
def test_apostrophes_are_no_quotation_marks(text, quoted):
    (_, _, weight, _), = toxicity.hits(text.replace("said", "saw"), toxicity.Lexicon({"vile": 2.0}))
    assert weight == (2.0 * toxicity.QUOTED_SHARE if quoted else 2.0)


def test_every_learned_term_is_kept():
    letters = "abcdefghij"
    counts = {f"{a}{b}{c}": (50, 0) for a in letters for b in letters for c in letters}
    assert len(toxicity.learned_terms(counts, 100, 100)) == 1000


ODD_ROWS = [(None, None), (None, ""), (None, "same words here."), (7, "same words here."), (7, "same words here."), (7, None), (8, "a 日本 " * 30), (9, " \n\t\x0b")]


def odd_frame(spark):
    return frame(spark, [t for _, t in ODD_ROWS], [i for i, _ in ODD_ROWS])


def test_packings_take_null_and_repeated_ids_and_empty_tables(spark):
    docs = odd_frame(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(word_ids.VOCABULARY))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD_ROWS)
    for made in (packing.pack(docs, capacity=16), binpack.pack(docs, capacity=16)):
        rows = made.collect()
        assert sum(r.length for r in rows) == total and {r.doc_id for r in rows} == {None, 7, 8, 9}
        assert sum(r.start == 0 for r in rows) == len(ODD_ROWS)
    for made in (packing.pack(docs.limit(0)), binpack.pack(docs.limit(0)), catalogue.op2(docs.limit(0))):
        assert made.collect() == []


def test_very_long_texts_are_cut_in_parts(spark):
    text = "No end of it " * 4000 + "." + " One more. " * 4000
    pieces_hold(packing.pack(frame(spark, [text, "short", text]), block=5000).collect(), [text, "short", text], 4096)
    assert [r.n_tokens for r in bpe.digests(frame(spark, [text]), block=1000).collect()] == [len(bpe_ids(text))]


def bpe_ids(text):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    return known.encode_ordinary(text)


def test_cuts_stand_inside_a_sentence_only_where_no_window_holds_it():
    ends, costs = packing.with_gaps_cut(np.array([10, 110, 350, 360]), np.array([4, 4, 4, 0]), 100, 48)
    assert ends.tolist() == [10, 110, 158, 206, 254, 302, 350, 360] and costs.tolist() == [4, 4, 12, 12, 12, 12, 4, 0]


def test_scores_and_rules_of_odd_rows(spark):
    docs = odd_frame(spark)
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (None, 1, 1), (7, 0, 1)], "doc_id long, toxic int, quality int")
    for made in (toxicity.op7(docs, labels), line_crf.op10(docs, labels), line_quality.op3(docs)):
        assert Counter(r.doc_id for r in made.collect()) == Counter(i for i, _ in ODD_ROWS)
    for made in (toxicity.op7(docs.limit(0), labels.limit(0)), line_crf.op10(docs.limit(0), labels.limit(0)), line_quality.op3(docs.limit(0))):
        assert made.collect() == []


def test_hosts_paths_and_rules_match_sql(spark):
    import duckdb

    urls = ["https://A.Example.COM/en/1?x", "http://www.example.com/en/2", "http://x.net/es/", "net", None, "", "http://com", "ftp://a.net/fr/1#t", "http://notcom/x", "http://b.com/y?a/b", "://com/z", "a://b://c.com/d", "x://COM?q", "x://É.com/É#", "http://net/fr", "http://a.b.net/fr/x/y"]
    pages = spark.createDataFrame([(None if k == 3 else k, u, "h") for k, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.op1(pages).collect())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(None if k == 3 else k, u) for k, u in enumerate([*urls, *urls])])
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    con.execute(f"create table rules as select * from (values {rules}) as r(verdict, host, path)")
    want = con.execute("""
        with p as (select page_id, url, row_number() over () as k, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        h as (select *, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
          regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from p),
        f as (select h.k, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
          from h join rules r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path) group by h.k)
        select page_id, host, path, rule, verdict from h left join f using (k)
    """).fetchall()
    assert got == Counter(want)


def test_url_model_matches_counts_by_hand(spark):
    """Witten-Bell probabilities over dictionaries of contexts, and the threshold over all edges of the score's bins."""
    rng = random.Random(9)
    letters = "ab/.é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    symbols = lambda t: ["^"] * url_filter.ORDER + ["?" if b > 127 or chr(b) not in url_filter.ALPHABET else chr(b) for b in t.encode()]
    seen = {}
    for t in texts:
        s = symbols(t)
        for k in range(url_filter.ORDER, len(s)):
            for n in range(url_filter.ORDER + 1):
                own = seen.setdefault(tuple(s[k - n : k]), {})
                own[s[k]] = own.get(s[k], 0) + 1

    def probability(context, symbol):
        if context is None:
            return 1 / url_filter.SYMBOLS
        shorter = probability(context[1:] if context else None, symbol)
        own = seen.get(tuple(context), {})
        total, kinds = sum(own.values()), len(own)
        return (own.get(symbol, 0) + kinds * shorter) / (total + kinds) if total else shorter

    counts = np.bincount(url_filter.grams(texts)[0], minlength=url_filter.SYMBOLS ** (url_filter.ORDER + 1))
    table = url_filter.log_probabilities(counts)
    for t in texts[:20] + ["zz/a", "é"]:
        s = symbols(t)
        want = np.mean([np.log(probability(s[k - url_filter.ORDER : k], s[k])) for k in range(url_filter.ORDER, len(s))])
        assert np.isclose(url_filter.score([t], table)[0], want, atol=1e-4)


def test_lexicon_matches_what_automata_find_in_the_whole_lexicon():
    rng = random.Random(11)
    letters = "abcde"
    terms = {"".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) + rng.choice(["", "", "*"]): rng.randrange(1, 9) / 2 for _ in range(60)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        base = rng.choice(list(terms)).rstrip("*")
        word = list(base)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", *letters])
        word = "".join(word)
        if not word:
            continue
        exact = [w for t, w in terms.items() if t == word or (t.endswith("*") and word.startswith(t[:-1]))]
        near = []
        for t, w in terms.items():
            if not t.endswith("*") and len(t) >= toxicity.FUZZY_LETTERS:
                automaton = toxicity.Levenshtein(t, 1)
                state = automaton.start()
                for c in word:
                    state = automaton.step(state, c)
                if automaton.accepts(state) == 1:
                    near.append(w * (toxicity.SHORT_EDIT_SHARE if len(t) <= toxicity.SHORT_LETTERS else toxicity.EDIT_SHARE))
        want = (max(exact), 0) if exact else (max(near), 1) if near else None
        assert (lexicon.match(word) if lexicon.possible(word) else None) == want, word
