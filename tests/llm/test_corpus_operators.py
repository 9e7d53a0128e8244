"""Operators that compare texts with each other, the pipeline and the catalogue."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from spanloom.llm import catalogue, exact_dedup, near_dedup, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, doc long, h long, id string, fp string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "l", 7, 8, "i", "f") for i, t in rows], SCHEMA)


def brute_fingerprint(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    root = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_simhash_matches_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", " \n", "One", "one", "ONE two", "one two\x0bthree", "É É É é"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(k * 5 % 97, t) for k, t in enumerate(texts)] + [(3, texts[-1]), (3, texts[-1]), (None, None)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    pairs = [(i if i is not None else -(2**63), brute_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in pairs})
    component = dict(zip(distinct, brute_components(distinct, 3), strict=True))
    least = {}
    for i, f in pairs:
        least[component[f]] = min(i, least.get(component[f], i))
    assert Counter((r.id, r.fp, r.component) for r in got) == Counter(
        (None if i == -(2**63) else i, int(np.uint64(f).astype(np.int64)), None if least[component[f]] == -(2**63) else least[component[f]]) for i, f in pairs
    )
    assert simhash.op4(frame(spark, rows).limit(0)).collect() == []


def test_links_span_what_all_pairs_link(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    values = {0, 2**64 - 1}
    for c in centres:
        for _ in range(60):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    want = brute_components(values, 3)
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)  # buckets are hot
    fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    root = list(range(len(values)))
    at = {v: k for k, v in enumerate(values)}
    for r in simhash.links(fps).collect():
        a, b = (at[int(np.int64(x).astype(np.uint64))] for x in (r.a, r.b))
        assert (values[a] ^ values[b]).bit_count() <= 3
        old, new = root[a], root[b]
        root = [new if x == old else x for x in root]
    assert len(set(zip(root, want, strict=True))) == len(set(root)) == len(set(want))


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (205, 200), (205, 203), (201, 203)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and {got[k] for k in (200, 201, 203, 205)} == {200}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffixes(rows, length):
    texts = [(i if i is not None else -(2**63), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for (i, _), (k, b) in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (k, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(100, 32, 1024), (20, 8, 1024), (20, 8, 2)])
def test_suffix_dedup_matches_brute_force(spark, length, gram, hot):
    rng = random.Random(length + hot)
    bases = ["".join(rng.choice("abcdé日 \n") for _ in range(300)) for _ in range(5)]
    rows = [(None, bases[0][:150]), (0, None), (2, ""), (4, "é" * 90)]
    for k in range(160):
        kind, base = rng.random(), rng.choice(bases)
        noise = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(50)))
        a = rng.randrange(200)
        text = base if kind < 0.2 else noise() + base[a : a + rng.randrange(20, 180)] + noise() if kind < 0.8 else rng.choice(["ab", "a"]) * rng.randrange(150)
        rows.append((10 + k * 7 % 170, text))
    rows += [(500, bases[1]), (500, bases[1]), (501, bases[2] + "x"), (501, bases[2] + "y")]
    got = suffix_dedup.dedup(frame(spark, rows), ["h", "lang"], length=length, gram=gram, hot=hot, shallow=16).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute_suffixes(rows, length))
    assert {r.h for r in got} == {8} and all(r.kept_text is None for r in got if r.doc_id == 0)
    assert suffix_dedup.op8(frame(spark, rows).limit(0)).collect() == []


def test_blind_trie_orders_and_groups():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(8)).encode() for _ in range(300)]
    trie = suffix_dedup.BlindTrie(8)
    for k, t in enumerate(texts):
        assert texts[trie.add(t, k)[0]] == t
    leaves = [sorted(leaf) for leaf in trie.ordered()]
    assert [texts[leaf[0]] for leaf in leaves] == sorted(set(texts))
    assert all(leaf == [k for k, t in enumerate(texts) if t == texts[leaf[0]]] for leaf in leaves)


def test_kept_text_leaves_characters_whole():
    data = "aé日b".encode()
    assert suffix_dedup.kept_text(data, [(2, 4)]) == "aé日b"
    assert suffix_dedup.kept_text(data, [(1, 6)]) == "ab"
    assert suffix_dedup.kept_text(data, [(1, 3), (4, 5)]) == "a日b"


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_groups_match_brute_force(spark, hash_all):
    texts = [None, "", " \t", "a b", "ab", "a  b", "a\x0bb ", "AB", "é é", "éé", "x" * 200 + "1", "x" * 200 + "2", "x" * 100 + " " + "x" * 100 + "1", "a b"]
    rows = [(k * 3 % 17, t) for k, t in enumerate(texts)] + [(None, "a b"), (4, "éé"), (4, "éé")]
    groups = {}
    for i, t in rows:
        key = re.sub("[ \t-\r]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), i if i is not None else -(2**63)))
    want = []
    for i, t in rows:
        key = re.sub("[ \t-\r]", "", t or "")
        mine, best = (-len(t or ""), i if i is not None else -(2**63)), min(groups[key])
        sha = hashlib.sha256(key.encode()).hexdigest() if hash_all or len(groups[key]) > 1 else None
        want.append((i, None if best[1] == -(2**63) else best[1], len(groups[key]), mine == best, sha))
    got = exact_dedup.exact_groups(frame(spark, rows), hash_all=hash_all).collect()
    plain = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept)
    assert Counter(map(plain, got)) == Counter(w[:4] for w in want)
    if hash_all:
        assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((w[0], w[4]) for w in want)
    else:
        assert all(r.text_sha256 for r in got if r.group_size > 1)
    assert exact_dedup.exact_groups(frame(spark, rows), ["text", "lang"], hash_all=hash_all).where("lang = 'l'").count() == len(rows)
    assert exact_dedup.op6(frame(spark, rows).limit(0)).collect() == []


def test_every_operator_has_its_query_and_the_pipeline_its_stages():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalogue.queries()) == list(range(1, 11))
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "suffix_dedup", "packing"]


def test_pipeline_decides_stage_by_stage(spark, tmp_path):
    rng = random.Random(11)
    sentence = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(12)) + "."
    rows, labels = [], []
    for k in range(120):
        toxic = k % 3 == 0
        rows.append((k, "\n".join([sentence() for _ in range(4)] + (["you worthless clown"] if toxic else []))))
        labels.append((k, int(toxic), 1))
    rows += [(200, rows[1][1]), (201, rows[2][1] + "  "), (202, None), (203, "")]
    passage = " ".join(sentence() for _ in range(3))
    rows += [(204, sentence() + "\n" + passage), (205, passage + "\n" + sentence())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for n, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert n == "packing" or docs.columns == corpus_pipeline.COLUMNS
    clean = {i for i, t in rows if "worthless" not in (t or "")}
    assert set(seen[0]) == clean
    assert set(seen[1]) == clean - {200, 2, 203}  # 201 is longer than 2; null and empty are equal
    assert set(seen[2]) == set(seen[1])
    assert passage not in seen[3][205].text and passage in seen[3][204].text and seen[3][205].n_chars == len(seen[3][205].text)
    assert seen[3][202].text is None and seen[3][1].text == rows[1][1]
    assert set(seen[4]) == set(seen[3])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in run} == {(r.doc_id, r.start, r.ids_crc32) for r in docs.collect()}


def five_word_sets(texts):
    words = [(t or "").split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_near_stage_drops_what_five_word_shingles_make_alike(spark, monkeypatch):
    rng = random.Random(12)
    pick = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", "one two", "one  two", "one three", "a b c d e f"]
    for edits in (0, 1, 2, 3, 4, 5, 6, 8, 12):
        base = pick(200)
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(200), edits):
                copy[k] = f"n{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    chain = pick(200)
    for _ in range(30):  # a chain: neighbours are alike, its ends are not
        texts.append(" ".join(chain))
        chain = [*chain[12:], *pick(12)]
    ids = rng.sample(range(1000), len(texts))
    rows = [*zip(ids, texts, strict=True), (ids[-1], texts[-1])]
    found = five_word_sets([t for _, t in rows])
    root = list(range(len(rows)))
    for i, a in enumerate(found):
        for j in range(i):
            if a == found[j] or a and 5 * len(a & found[j]) >= 4 * len(a | found[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = [min(i for (i, _), r in zip(rows, root, strict=True) if r == k) for k in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert Counter(kept) == Counter(i for (i, _), k in zip(rows, least, strict=True) if i == k)
    # The compared ends of a bucket alone don't decide: one bucket of all texts gives the same components.
    one = lambda found: np.zeros(min(len(found), 1), np.uint64)
    monkeypatch.setattr(near_dedup, "bands", one)
    got = near_dedup.near_copies(docs).collect()
    assert Counter((r.id, r.component) for r in got) == Counter((i, k) for (i, _), k in zip(rows, least, strict=True))
    # So do tiles of a few sets each.
    monkeypatch.setattr(near_dedup, "TILE_SETS", 7)
    monkeypatch.setattr(near_dedup, "MATRIX_COLUMNS", 5)
    got = near_dedup.near_copies(docs).collect()
    assert Counter((r.id, r.component) for r in got) == Counter((i, k) for (i, _), k in zip(rows, least, strict=True))
    assert near_dedup.near_copies(docs.limit(0)).collect() == []


@pytest.mark.parametrize("many", [2, 5, 16])
def test_linked_sets_span_what_all_pairs_link(monkeypatch, many):
    monkeypatch.setattr(near_dedup, "MANY", many)
    rng = np.random.default_rng(many)
    found = []
    for _ in range(12):
        base = rng.integers(0, 400, 60)
        for _ in range(6):
            copy = base.copy()
            copy[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 400)
            found.append(np.unique(copy).astype(np.uint64))
    root = np.arange(len(found))
    root[1] = 0  # known to be together
    alike = [[near_dedup.jaccard(a, b) >= 0.8 for b in found] for a in found]

    def spread(pairs):
        own = root.copy()
        for i, j in pairs:
            own[own == own[j]] = own[i]
        return {tuple(np.flatnonzero(own == r)) for r in own}

    links = near_dedup.linked(found, root, 0.8)
    assert all(alike[i][j] for i, j in links) and len(links) < len(found)
    assert spread(links) == spread([(i, j) for i in range(len(found)) for j in range(i) if alike[i][j]])


def test_only_survivors_of_length_and_prefix_are_grouped_by_full_hash(spark, monkeypatch):
    rows = [(1, "a b"), (2, "ab"), (3, "cd"), (4, "long text")]
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_groups(frame(spark, rows)).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    grouped = []
    kind = type(spark.range(0))
    group_by = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *c: grouped.append((c, self)) or group_by(self, *c))
    exact_dedup.exact_groups(frame(spark, rows))
    monkeypatch.undo()
    by_full = next(df for c, df in grouped if "full" in c)
    assert sorted(r.id for r in by_full.collect()) == [1, 2]


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    rows = [*[(7, "twice told", "en")] * 40, (8, "twice told", "en"), (None, "no id", "en"), (None, "no id", "de"), (None, "no id", "de"), (1, "a b", "en"), (1, "b a", "en"), (2, "a  b", "en"), (None, None, "en"), (None, "", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text, r.lang) for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect())
    assert got == Counter([(7, "twice told", "en"), (None, "no id", "de"), (1, "b a", "en"), (2, "a  b", "en"), (None, None, "en")])


def test_stages_take_clashing_columns_null_ids_and_empty_tables(spark, tmp_path):
    text = "one two three four five six seven eight nine ten " * 4
    rows = [(None, None), (None, text), (3, text), (3, text), (4, ""), (5, text + "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k long, id string, later_id string")
    spark.createDataFrame([(3, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        kept[name] = Counter(r.doc_id for r in made.collect())
        assert name == "packing" or made.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert kept["toxicity"] == Counter(i for i, _ in rows) and set(kept["packing"]) == {i for i, _ in rows}  # one row for each piece
    assert kept["suffix_dedup"] == Counter([None, None, 4, 5])  # nothing is left of the rows with id 3
    assert kept["exact_dedup"] == Counter([None, None, 5]) and kept["simhash"] == Counter([None, None])


def test_null_ids_are_no_number(spark):
    rows = [(None, "a b"), (-(2**63), "c d"), (5, "a b"), (6, "c d")]
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.op6(frame(spark, rows)).collect()} == {(None, None), (5, None), (-(2**63), -(2**63)), (6, -(2**63))}
    assert {(r.doc_id, r.component_id) for r in simhash.op4(frame(spark, rows)).collect()} == {(None, None), (5, None), (-(2**63), -(2**63)), (6, -(2**63))}
