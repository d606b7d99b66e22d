"""The operators beside brute force, the libraries themselves, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidstone.llm import chat_format, embedding_dedup, exact_dedup, language_id, lattice_lm, ngram_jaccard, packing, piece_codec, secret_scan, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, __bs_text string, kept string, n long"
WORDS = "alpha beta gamma delta über naïve the of and red blue 12 x-1".split()


def _text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n", str(rng.randrange(300))]) for _ in range(n))


def _rows() -> list[tuple]:
    rng = random.Random(3)
    base = _text(rng, 120)
    texts = [None, "", "   ", "one", "one two three", base, base, base + " more", base.replace("red", "blue", 1), "x" * 30_000, _text(rng, 6000), "日本 🎉 \t tab  two  blanks \n\n end ", "<|endoftext|> </s> ▁ mark"]
    texts += [_text(rng, rng.randrange(1, 400)) for _ in range(40)]
    near = texts[20].split(" ")
    texts += [" ".join(near[:i] + ["changed"] + near[i + 1 :]) for i in range(0, min(len(near), 60), 7)]
    rows = [(i, t, "en" if i % 4 else None, "clash", "clash", i) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, none):
    rows = _rows()
    groups: dict[str, list[int]] = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = exact_dedup.exact_dedup(docs, block_chars=64)
    assert out.columns == ["doc_id", "text", "lang", "__bs_text", "input_kept", "n", "keep_id", "group_size", "kept"]
    got = out.collect()
    assert {(r["__bs_text"], r.input_kept) for r in got} == {("clash", "clash")}
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, max(groups[t or ""]), len(groups[t or ""])) for i, t, *_ in rows)
    assert Counter(r.keep_id for r in got if r.kept) == Counter({max(g): 1 for g in groups.values()})
    stay = exact_dedup.kept_rows(docs, block_chars=64)
    assert stay.columns == docs.columns and Counter(tuple(r) for r in stay.collect()) == Counter({rows[max(g)]: 1 for g in groups.values()})
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.kept_rows(none).count() == 0


def test_names_follow_the_order_of_blocks(spark):
    """Equal blocks one name, larger ones larger names, common ones apart; ids null or repeated."""
    rng = random.Random(8)
    blocks = ["".join(rng.choice("ab") for _ in range(3)) for _ in range(4000)] + ["hot"] * 3000
    df = spark.createDataFrame([(i, 1, b) for i, b in enumerate(blocks)], "u long, l int, b string").repartition(5)
    got = exact_dedup._name(df, ["b"], "names").collect()
    names = {}
    for r in got:
        assert names.setdefault(blocks[r.u], r["__bs_name"]) == r["__bs_name"]
    assert len(got) == len(blocks) and len(set(names.values())) == len(names)
    few = spark.createDataFrame([(i, 1, f"{i % 700:04d}") for i in range(1400)], "u long, l int, b string").repartition(5)
    by_block = sorted({(f"{r.u % 700:04d}", r["__bs_name"]) for r in exact_dedup._name(few, ["b"], "names").collect()})
    assert len(by_block) == 700 and [x[1] for x in by_block] == sorted(x[1] for x in by_block)
    rows = [(None, "t"), (None, "t"), (4, "t"), (4, "u"), (4, "u"), (None, None), (7, "")]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.text or "", r.keep_id, r.group_size) for r in out) == Counter({("t", 4, 3): 3, ("u", 4, 2): 2, ("", 7, 2): 2})
    assert Counter(r.text or "" for r in out if r.kept) == {"t": 1, "u": 1, "": 1}


def _sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def _classes(sets):
    low = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(low)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
        if low == before:
            break
    return low


def test_ngram_jaccard(docs, none):
    sets = _sets(_rows())
    low = _classes(sets)
    got = ngram_jaccard.jaccard_classes(docs).collect()
    assert len(got) == len(_rows())
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), low[i]) for i, s in sets.items()}
    each = [sets[i] for i, *_ in _rows()]
    links = Counter((i, sum(_near(sets[i], x) for x in each) - bool(sets[i])) for i, *_ in _rows())
    assert Counter((r.doc_id, r.n_links) for r in got) == links
    assert ngram_jaccard.jaccard_classes(none).count() == ngram_jaccard.first_of_each(none).count() == 0


def _near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def _family(rng, n, size=60):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(size)] = f"x{rng.randrange(40)}"
        yield " ".join(words)


@pytest.mark.parametrize("held", [700])
def test_links_of_near_copies(spark, monkeypatch, held):
    """Rows with null, repeated and clashing columns; large groups told in parts, classes counted in several blocks."""
    rng = random.Random(6)
    texts = [t for n in (150, 40, 2, 1, 1) for t in _family(rng, n)] + ["a b c", "A b C", "", None]
    rows = [(rng.randrange(150), t, t and t[::-1], 1) for t in texts] + [(None, texts[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, n int")
    monkeypatch.setattr(ngram_jaccard, "HELD", held)
    monkeypatch.setattr(ngram_jaccard, "GROUP_ROW", 4096 if held > 1000 else 8)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_TOKENS", 1_500_000 if held > 1000 else 2000)
    sets = [s if i is not None else set() for (i, *_), s in zip(rows, _sets([(k, t) for k, (_, t, *_) in enumerate(rows)]).values(), strict=True)]
    low = _classes(dict(enumerate(sets)))
    component = {c: min((rows[k][0] for k in low if low[k] == c and rows[k][0] is not None), default=None) for c in set(low.values())}
    want = Counter((i, component[low[k]], sum(_near(sets[k], x) for x in sets) - bool(sets[k])) for k, (i, *_) in enumerate(rows))
    assert Counter((r.doc_id, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_classes(df).collect()) == want
    stay = ngram_jaccard.first_of_each(df)
    assert stay.columns == df.columns
    kept = [tuple(r) for r in stay.collect()]
    place = {(r[0], r[1]): k for k, r in reversed([*enumerate(rows)])}
    first = {c: min((rows[k][0], k) for k in low if low[k] == c)[0] for c in {low[k] for k in low if sets[k]}}
    of = Counter((low[place[r[0], r[1]]], r[0]) for r in set(kept) if sets[place[r[0], r[1]]])
    assert of == Counter({(c, i): 1 for c, i in first.items()})
    assert Counter(r for r in kept if not sets[place[r[0], r[1]]]) == Counter(r for r, s in zip(rows, sets, strict=True) if not s)


@pytest.mark.parametrize("frequent", [0, 3, 32])
def test_links_counted_in_blocks(monkeypatch, frequent):
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", frequent)
    rng = np.random.default_rng(frequent)
    make = lambda n: [np.unique(rng.choice(60, rng.integers(20, 60), replace=False).astype(np.uint64)) for _ in range(n)]
    x, y, t = make(700), make(90), ngram_jaccard.Fraction(1, 2)
    mx, my = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    near = np.array([[2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) for b in y] for a in x])
    of_x, of_y = ngram_jaccard.count_links(x, y, mx, my, t)
    assert of_x.tolist() == (near @ my).tolist() and of_y.tolist() == (mx @ near).tolist()
    near = np.array([[2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) for b in y] for a in y]) & ~np.eye(len(y), dtype=bool)
    assert ngram_jaccard.count_links(y, y, my, my, t, same=True)[0].tolist() == (near @ my).tolist()


def test_lanes_meet_whatever_is_left_out():
    rng, bands = np.random.default_rng(1), ngram_jaccard.Bands()
    for n in (5, 9, 40, 300, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = int(n * rng.uniform(0, 0.1))
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64))))
            if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
                continue
            for share in (0, 0.3, 0.8, 1):
                skip = rng.choice(np.union1d(a, b), int(share * n), replace=False)
                keys = [ngram_jaccard.lane_keys(x, np.setdiff1d(x, skip), bands) for x in (a, b)]
                assert len(np.intersect1d(*keys)) or (a.tolist() == b.tolist())


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BPE)
    tk.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in _rows():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids)] += len(ids)
    got = packing.pack(docs, BPE).toPandas()
    assert Counter({k: int(n) for k, n in got.groupby(["doc_id", "doc_tokens"])["length"].sum().items()}) == want
    ids_of = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in _rows()}
    assert all(zlib.crc32(ids_of[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["length"].cumsum() - s["length"] == s["offset"]).all()
        n = s["length"].sum()
        assert n == 2048 or n < 2048 and not n & (n - 1)
    assert packing.pack(none, BPE).count() == 0


def _blank_runs():
    """Texts with every run of up to seven of a letter, a blank and a line feed, and longer runs."""
    yield from ("".join(x) for n in range(8) for x in itertools.product("a \n", repeat=n))
    yield from ("a\n\n\nb", "a b\n\n", "a\n\n", *(f"a's{chr(10) * n}1{chr(10) * (n - 1)} .b" for n in range(1, 20)))


def test_line_feeds_in_a_row_as_the_library():
    from tokenizers import Tokenizer

    tk, known = Tokenizer.from_file(BPE), packing.chunk_ids(BPE)
    for t in _blank_runs():
        want = tk.encode(t, add_special_tokens=False).ids
        assert known.ids(t).tolist() == want, t
        assert token_counts.TokenTree(t, known).total == len(want), t
        tree = token_counts.TokenTree(f"x\n{t}", known)
        tree.edit(1, 1, "\n\n")
        assert tree.total == len(tk.encode(f"x\n\n{t}", add_special_tokens=False).ids), t


MARK = "<|endoftext|>"
MARKED = [f"x{MARK}y", MARK, f"a {MARK}\n b", f"a\n {MARK} b", f"a\n\n{MARK}\n\nb", f"{MARK}{MARK} 's", f"a \t{MARK}", MARK[:-1], f"quoted {MARK}. more"]


def test_added_tokens_as_the_library_by_default(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from braidstone.llm import queries

    tk, known = Tokenizer.from_file(BPE), packing.chunk_ids(BPE)
    want = {i: tk.encode(t, add_special_tokens=False).ids for i, t in enumerate(MARKED)}
    assert want[0] == [87, 50256, 88]
    df = spark.createDataFrame([*enumerate(MARKED)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op2_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packed(spark, df, "").collect()):
        assert {r.doc_id for r in got} == set(want)
        for r in got:
            ids = np.array([*want[r.doc_id], 1], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()), MARKED[r.doc_id]
    for i, t in enumerate(MARKED):
        assert token_counts.TokenTree(t, known).total == len(want[i]), t
        for at in range(len(t)):  # the mark is broken, then made whole again
            tree = token_counts.TokenTree(t, known)
            tree.edit(at, 1, "")
            assert tree.total == len(tk.encode(t[:at] + t[at + 1 :], add_special_tokens=False).ids), (t, at)
            tree.edit(at, 0, t[at])
            assert tree.text() == t and tree.total == len(want[i]), (t, at)


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_item_once(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.choice([1500, 1, 7, rng.randrange(1, 2049)]) if seed else 1500 for _ in range(700))
    plan = packing.Plan(dict(lengths)).arrays()
    items = [(x, r) for x, n in lengths.items() for r in range(n)]
    item, skip, took, seq, off = packing.place(plan, np.array([x for x, _ in items]), np.array([r for _, r in items]))
    for i, (x, _) in enumerate(items):
        at = item == i
        assert sorted(zip(skip[at], took[at])) == sorted(zip(np.cumsum(np.append(0, took[at][:-1])), took[at])) and took[at].sum() == x
    filled = sorted(zip(seq.tolist(), off.tolist(), took.tolist()))
    at, ends = 0, Counter()
    for s, o, n in filled:
        assert o == ends[s]
        ends[s] += n
    assert all(n <= 2048 and not n & (n - 1) for n in ends.values())
    assert at == 0


SECRETS = ["", None, 'password = "abc" TOKEN: x=1234567, api_key=ABCDEF', "token=token:abcdefg AKIA" + "A" * 16 + " AKIAB", "f" * 23 + " " + "0a" * 12 + "g ü " + "deadbeef" * 4, "ſecret=abcdefgh ToKen='zzzzzz'", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c -----BEGIN RSA PRIVATE KEY----- ghp_" + "A1" * 20]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secret_scan(spark, none):
    df = spark.createDataFrame([*enumerate(SECRETS)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(df)).collect()}
    for i, t in enumerate(SECRETS):
        t = t or ""
        s = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i].base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(s)).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in s) for k in range(3))
    assert got[6].spans.count(":") == 6 and "jwt:0:" in got[6].spans
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean[1] is None and clean[3] == "[secret] ".replace("[secret] ", "token=token:abcdefg ") + "[secret] AKIAB"
    assert secret_scan.digest(secret_scan.scan(none)).count() == 0


def test_secrets_of_odd_rows(spark):
    """Ids null or repeated, columns with any name, a long text."""
    long = "lorem ipsum " * 20_000 + "token=abcdefgh"
    rows = [(1, SECRETS[3], "raw", "k", 1), (1, "clean", "raw", "k", 1), (None, "api_key: 'xyzxyz'", "raw", "k", 2), (None, None, "raw", "k", 2), (5, long, "raw", "k", 3), (5, long, "raw", "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __bs_text string, kinds string, spans int")
    got = Counter((r.doc_id, r.n_assign, r.n_access) for r in secret_scan.digest(secret_scan.scan(df)).collect())
    assert got == Counter({(1, 0, 1): 1, (1, 0, 0): 1, (None, 1, 0): 1, (None, 0, 0): 1, (5, 1, 0): 2})
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns
    want = ["token=token:abcdefg [secret] AKIAB", "clean", "[secret]'", None, long[:-14] + "[secret]", long[:-14] + "[secret]"]
    assert Counter(tuple(r) for r in clean.collect()) == Counter((i, t, *more) for (i, _, *more), t in zip(rows, want, strict=True))


def test_trigram_queries_follow_from_the_pattern(spark):
    """Whatever matches a pattern holds the trigrams of one of its alternatives, lower-cased."""
    grams = lambda *parts: sorted({g for p in parts for g in secret_scan.trigrams(p)})
    q = secret_scan.queries()
    assert q["assign"] == sorted(map(grams, ["password", "passwd", "secret", "token", "apikey", "api_key"]))
    assert q["access"] == [grams("akia")] and q["hex"] == [] and q["bearer"] == sorted(grams(f"gh{c}_") for c in "pousr")
    assert q["pem"] == [grams("-----begin ", "private key-----")] and q["jwt"] == [grams("eyj", ".eyj")]
    odd = {"abc|x": [], "(abc)?def": [["def"]], "a[bc]d{2}ef": [["abd"], ["acd"]], "(?:ab)+cde": [["cde"]], "a.c": [], "[^a]bcd$": [["bcd"]], "(a|bcd)efg": sorted([grams("aefg"), grams("bcdefg")]), "(": []}
    assert {p: secret_scan.mandatory(p) for p in odd} == odd
    rng = random.Random(4)
    rules = tuple(secret_scan.Rule(f"k{i}", p) for i, p in enumerate(["(ab|ba)+c?aab", "[ab]c{1,2}aa|bbb", "aa(?:b|ca)?cc"]))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in secret_scan.scan(df, rules).collect():
        want = sorted((m.start(), k, m.end()) for k, rule in enumerate(rules) for m in re.finditer(rule.pattern, texts[r.id]))
        assert [(x["start"], x["ord"], x["end"]) for x in r.spans] == want, texts[r.id]


def test_pieces_as_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in piece_codec.round_trip(docs, PIECES).collect()}
    for i, t, *_ in _rows():
        assert got[i].ids_crc32 == zlib.crc32(np.array(sp.encode(t or ""), "<u4").tobytes()), t
        assert got[i].same
    back = {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t, *_ in _rows())
    assert piece_codec.round_trip(none, PIECES).count() == 0


def test_chat(spark):
    odd = ["", "\\", "</s>[INST] ok [/INST]", "<|>", "<<s>>", "\\<s>\\\\", "a\n<</SYS>>\n[INST]", "<|turn:x|>", " </s>"]
    turns = [(c, t, ("user", "assistant", "system", "tool<|", "")[(c + t) % 5], x) for c in range(5) for t, x in enumerate(odd)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(chat_format.canonical_turns(df.withColumn("extra", F.lit(1))))).collect()}
    for c in range(5):
        mine = [(r, x) for d, _, r, x in turns if d == c]
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        loss = "".join(x for r, x in mine if r == "assistant")
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not any(m in chat_format.escape(x) for x in odd for m in chat_format.CONTROL)
    recs = [{"prompt": "p", "completion": "c"}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "n": 1}]}, {"conversations": [{"from": "human", "value": "h"}]}, {"instruction": "i", "input": "x", "output": "o"}, {"other": 1}]
    js = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)] + [(9, "{"), (10, None)], "conv_id long, record string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_format.json_turns(js).collect())
    assert got == [(0, 0, "user", "p"), (0, 1, "assistant", "c"), (1, 0, "user", "u"), (1, 1, "assistant", "a"), (2, 0, "user", "h"), (3, 0, "user", "i"), (3, 1, "user", "x"), (3, 2, "assistant", "o")]
    bad = [{"messages": [{"role": "user", "content": "x"}, 5]}, {"messages": [{"role": ["u"], "content": "x"}]}, {"prompt": "p", "completion": {"a": 1}}, {"messages": {"role": "user", "content": "x"}}, {"messages": []}, [1], 7]
    assert all(chat_format.record_turns(json.dumps(r)) == [] for r in bad)
    assert chat_format.record_turns('{"prompt": "p", "completion": null}') == [("user", "p"), ("assistant", "")]


def test_chat_odd_rows(spark):
    """Null texts, roles and ids, repeated rows, a long text, an empty table."""
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "of no one"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, "assistant", "</s>" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(chat_format.canonical_turns(df.withColumn("formatted", F.lit("clash"))))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in out.items()} == {1: (2, 0), None: (1, 0), 2: (2, 2), 3: (1, 200_000)}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\n\nx\n").hexdigest()
    assert chat_format.read_back(chat_format.format_chat(chat_format.canonical_turns(df.limit(0)))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_edits(seed):
    from tokenizers import Tokenizer

    tk, rng = Tokenizer.from_file(BPE), random.Random(seed)
    text = _text(rng, 80) + "  \t odd "
    tree = token_counts.TokenTree(text, packing.chunk_ids(BPE))
    for _ in range(40):
        at, cut, new = rng.randrange(len(text) + 3), rng.choice([0, 1, 5, 60]), rng.choice(["", " ", "\n", "ab", " new words here", "  ", "'s"])
        at_ = min(at, len(text))
        text = text[:at_] + new + text[at_ + cut :]
        tree.edit(at, cut, new)
        assert tree.text() == text and tree.total == len(tk.encode(text).ids)


def _segmentations(w):
    """The sum over all segmentations of a word, one after another, from the vocabulary's scores alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = {sp.id_to_piece(i): 1 / (lattice_lm.ZIPF_SHIFT - sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
    byte, end = min(plain.values()), 1 / (lattice_lm.ZIPF_SHIFT - sp.get_score(sp.eos_id()))
    whole = sum(plain.values()) + 256 * byte + end

    def paths(rest):
        if not rest:
            yield 1.0
        for e in range(1, len(rest) + 1):
            if rest[:e] in plain:
                yield from (plain[rest[:e]] / whole * x for x in paths(rest[e:]))
            elif e == 1:
                yield from ((byte / whole) ** len(rest[:1].encode()) * x for x in paths(rest[1:]))

    return end / whole if w is None else sum(paths("▁" + w))


def test_lattice_sums_over_all_segmentations(monkeypatch):
    lat = lattice_lm.lattice(PIECES)
    assert math.exp(lat.logp[lat.end]) == pytest.approx(_segmentations(None)) and np.exp(lat.logp).sum() == pytest.approx(1)
    words = ["the", "theory", "日x", "a", "über", "", "🎉é", "straightly"]
    for stretch in (lattice_lm.STRETCH, 3):
        monkeypatch.setattr(lattice_lm, "STRETCH", stretch)
        for at, codes in lat.by_length(words):
            for i, x in zip(at, lat.likelihood(codes)):
                assert x == pytest.approx(math.log(_segmentations(words[i])))


def test_scores_are_products_of_sums(spark):
    """A text's score from its words' segmentations and counts, by hand; clashing columns, null and repeated ids."""
    texts = [(1, "the theory of a"), (1, "the theory of a"), (2, "über the"), (None, "the 日x"), (16, "A theory, unseen"), (16, None)]
    texts += [(i, "of the") for i in range(20, 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("word", F.lit(1))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, ends = Counter(w for i, t in texts if not held(i) for w in (t or "").lower().split()), sum(not held(i) for i, _ in texts)
    n, v = counts.total() + ends, len(counts) + 1
    p = lambda c, sums: (c + (v + 1) * sums) / (n + v + 1)
    want = Counter((i, round(math.log10(p(ends, _segmentations(None))) + sum(math.log10(p(counts[w], _segmentations(w))) for w in (t or "").lower().split()), 6)) for i, t in texts)
    assert Counter((r.doc_id, round(r.score, 6)) for r in lattice_lm.score(df, PIECES).collect()) == want


def test_language_model(docs, none):
    counts, tokens = Counter(), {}
    for i, t, *_ in _rows():
        tokens[i] = (t or "").encode().lower().split()
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*tokens[i], "end"])
    n, v = sum(counts.values()), len(counts)
    got = lattice_lm.score(docs, PIECES).collect()
    assert len(got) == len(_rows())
    for r in got:
        w = [*tokens[r.doc_id], "end"]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.n_tokens == len(w) and r.train_tokens == n
        assert r.n_known == sum(counts[x] > 0 for x in w) and r.score < 0
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    assert lattice_lm.score(none, PIECES).count() == 0


def test_language_id(spark, docs, none):
    rng = random.Random(5)
    lexicon = {"xx": ["zug", "zwei", "und", "der"], "yy": ["que", "los", "una", "con"]}
    rows = [(i, " ".join(rng.choice(lexicon[k]) for _ in range(rng.randrange(3, 30))), k) for i in range(150) for k in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 34!", "yy"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows if got[i].held_out)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert language_id.identify(none).count() == 0
    assert {r.doc_id for r in language_id.identified_rows(df).collect()} == {i for i, *_ in rows}
    odd = spark.createDataFrame([(910, "½ ² 12 ٣ _", "xx", 1), (911, "zug und " * 50_000, "xx", 1), (None, "que los", None, 1), (1, "que los una", "yy", 1), (1, "que los una", "yy", 1)], "doc_id long, text string, lang string, score int")
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.identify(df.withColumn("score", F.lit(1)).unionByName(odd)).collect())
    assert got[910, "und"] == got[911, "xx"] == got[None, "yy"] == 1 and got[1, "yy"] == 3


def test_language_sample(spark):
    """Alike many of each language by smallest hash, however the table is ordered."""
    rows = [(str(i), f"l{int(i > 2000) + int(i > 2950)}", i * 7919 % 100_003 << 20) for i in range(3000)] + [("same", "l0", 5)] * 400
    df = spark.createDataFrame(rows, "text string, lang string, hash long").coalesce(1)
    got = language_id.training_sample(df, "lang", 300).collect()
    want = {k: {t for h, t in sorted({(h, t) for t, x, h in rows if x == k})[:100]} for k in ("l0", "l1", "l2")}
    assert {k: {r.text for r in got if r.lang == k} for k in want} == want and len(got) == 249
    assert language_id.training_sample(df.limit(0), "lang", 300).count() == 0


def _dense_ftrl(rows, classes):
    """The textbook update, one coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(i, k):
        l1, l2 = (0, 0) if i == language_id.FEATURES else (language_id.L1, language_id.L2)
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - math.copysign(l1, z[i, k])) / ((language_id.BETA + math.sqrt(n[i, k])) / language_id.ALPHA + l2)

    order = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for r in order.permutation(len(rows)):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (language_id.FEATURES, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in x for k in range(classes)}
            e = [math.exp(sum(v * w[i, k] for i, v in x)) for k in range(classes)]
            for i, v in x:
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == rows[r][2]))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / language_id.ALPHA * w[i, k]
                    n[i, k] += g * g
    return weight


def test_follow_the_regularised_leader():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.normal(size=6), int(rng.integers(3))) for _ in range(25)]
    w, b = language_id.ftrl(rows, 3)
    weight = _dense_ftrl(rows, 3)
    assert np.allclose(w[:30], [[weight(i, k) for k in range(3)] for i in range(30)])
    assert np.allclose(b, [weight(language_id.FEATURES, k) for k in range(3)]) and not w[30:].any()
    assert language_id.Model(["a", "b"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 2)), np.zeros(2), 1.0).accepts("letters") is False


@pytest.mark.parametrize("text", ["", "a", "abca", "Üß日本"])
def test_ngrams_of_one_to_three_characters(text):
    assert language_id.ngram_counts(text).sum() == sum(max(0, len(text) - n) for n in range(3))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    vec = np.concatenate((base, base[:20] + rng.normal(size=(20, 8)) * 0.06, base[:5], base[:1].repeat(30, 0)))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(vec)]
    odd = [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [None] * 8, 1), (504, vec[0].tolist(), None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    u = vec / np.linalg.norm(vec, axis=1)[:, None]
    label = np.arange(len(vec)) % 3
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    low = np.arange(len(vec))
    for _ in range(len(vec)):
        low = np.minimum(low, np.where(link, low[None], len(vec)).min(1))
    got = {r.vec_id: r for r in embedding_dedup.near_classes(df).collect()}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), low[i], low[i] == i) for i in range(len(vec)))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, *_ in odd)
    assert embedding_dedup.near_classes(df.limit(0)).count() == 0


def test_embeddings_with_repeated_ids(spark):
    """Links are those of a row's own vector; empty vectors, other sizes, ties and clashing columns."""
    c = math.cos(0.15)
    s = math.sin(0.15)
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [c, s], 0), (3, [c, -s], 0), (4, [s, c], 0), (4, [s, c], 0), (5, [], 0), (6, [2.0, 0.0, 0.0], 0), (7, [1.0, 0.0, 0.0], 0), (8, [1.0, 0.0], 1), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("x")).withColumn("cell", F.lit(1))
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_classes(df).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 2, 1), (4, 2, 1), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 0, 8), (None, 0, None)])


def test_multi_sequence_order():
    rng = random.Random(1)
    for _ in range(20):
        p, q = (sorted(rng.choice([0, 1, 2, rng.random() * 3]) for _ in range(rng.randrange(1, 9))) for _ in range(2))
        got = [p[i] + q[j] for i, j in embedding_dedup.multi_sequence(p, q, 2.5)]
        assert got == sorted(a + b for a in p for b in q if a + b <= 2.5)


def test_embedding_recall_and_pairs_compared(spark):
    """At the threshold itself at least RECALL of the pairs are found; the pairs compared grow far below the square."""
    def table(n):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 32))
        u = rng.normal(size=(n // 4, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        u -= (u * x[: n // 4]).sum(1)[:, None] * x[: n // 4]
        return np.concatenate((x, 0.981 * x[: n // 4] + math.sqrt(1 - 0.981**2) * u / np.linalg.norm(u, axis=1)[:, None]))

    def compared(x):
        grid = embedding_dedup.Grid(x, max(4, math.ceil(math.sqrt(len(x) / embedding_dedup.CELL))))
        own, row, cell = embedding_dedup.visits(x, grid)
        return np.bincount(own, minlength=cell.max() + 1)[cell].sum()

    x = table(1600)
    got = embedding_dedup.near_classes(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    true = (x @ x.T >= 0.98).sum(1) - 1
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum() > 700
    small, large = compared(x), compared(table(12_800))
    assert small < 0.5 * len(x) ** 2 and large < 24 * small  # 64 times the pairs


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t, *_ in _rows()[:-2]] + [(900, "my password = hunter22 is here", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    last = {}
    for i, t, *_ in rows:
        if t and any(c.isalpha() for c in t):
            last[t] = max(i, last.get(t, -1))
    sets = _sets([(i, t) for t, i in last.items()])
    low = _classes(sets)
    assert set(got["doc_id"]) == {i for i in sets if low[i] == i}
    text = dict((i, t) for t, i in last.items()) | {900: "my [secret] is here"}
    total = got.groupby("doc_id")["length"].sum()
    known = packing.chunk_ids(BPE)
    assert all(total[i] == len(known.ids(text[i])) + 1 for i in total.index)


def test_piece_codec_full_cache(monkeypatch):
    """A cache emptied between calls loses no word, and gives what the library gives."""
    import sentencepiece

    monkeypatch.setattr(piece_codec, "CACHE_WORDS", 5)
    codec, sp, rng = piece_codec.Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(5)
    for _ in range(6):
        texts = [_text(rng, 40), "the of and red", "x" * 700 + " 日本 🎉é \n\n  two", None, ""]
        for t, ids in zip(texts, codec.encode(texts), strict=True):
            assert ids.tolist() == (sp.encode(t) if t else [])


def _edited(text, edits):
    for e in filter(None, edits or []):
        at = min(max(e[0] or 0, 0), len(text))
        text = text[:at] + (e[2] or "") + text[at + max(e[1] or 0, 0) :]
    return text


def test_edited_counts(spark):
    """Null texts, edit lists, edits and fields, ids repeated or null, a text that grows a hundredfold."""
    from tokenizers import Tokenizer

    tk, rng = Tokenizer.from_file(BPE), random.Random(9)
    grow = [(rng.randrange(400 * (i + 1)), 0, " more words\nput in" * rng.randrange(1, 30)) for i in range(40)]
    rows = [(1, None, None), (1, None, [(0, 3, "new text")]), (2, "", []), (3, "a b  c", [None, (None, None, None), (99, 5, " end"), (-4, 2, "")]), (3, "a b  c", None), (None, "one two", [(0, 0, "x")]), (4, _text(rng, 30), grow), (5, "x" * 30_000, [(15_000, 1, " ")]), (5, _text(rng, 4000), grow)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:int,deleted:int,inserted:string>>")
    got = Counter((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in token_counts.edited_counts(df.withColumn("n_tokens", F.lit("clash")), BPE).collect())
    n = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    assert got == Counter((i, n(t or ""), len(e or []), n(_edited(t or "", e))) for i, t, e in rows)
    assert token_counts.edited_counts(df.limit(0), BPE).count() == 0


def test_every_chunk_keeps_a_leaf():
    """After long insertions an edit encodes again a few chunks, not all that were put in."""
    tree = token_counts.TokenTree("one two three", packing.chunk_ids(BPE))
    for at in (3, 5000, 12, 40_000):
        tree.edit(at, 0, " inserted words" * 4000)
        assert max(map(len, tree.leaves)) < 20 and tree.sums[:, 1].tolist() == tree.sums[:, tree.width :].sum(1).tolist()
    before = tree.encoded
    tree.edit(30_000, 4, "xy")
    assert tree.encoded - before <= 5


def test_sampled_edits(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BPE)
    made = token_counts.sample_edits(docs).collect()
    got = Counter((r.doc_id, r.n_tokens_after) for r in token_counts.edited_counts(token_counts.sample_edits(docs), BPE).collect())
    assert got == Counter((r.doc_id, len(tk.encode(_edited(r.text or "", r.edits), add_special_tokens=False).ids)) for r in made)


def test_rows_of_keys_grow_with_the_keys():
    """However many buckets and blocks of documents there are, a row holds many keys, and every key of every set is in one."""
    rng, bands = random.Random(8), ngram_jaccard.Bands()
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(3000)]
    sent = type("Sent", (), {"value": np.zeros(0, np.uint64)})
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts), pa.array(range(3000), pa.int64())], ["doc_id", "text", "tag"])
    out = pa.Table.from_batches(ngram_jaccard._emit(5, bands, 1000, sent)(iter([batch])))
    docs, rows = out.filter(out["keys"].is_null()), out.filter(out["keys"].is_valid())
    want = sorted((int(k), ngram_jaccard._set_id(s)[0]) for s in map(ngram_jaccard.shingles, texts) for k in ngram_jaccard.lane_keys(s, s, bands))
    got = sorted((int(k), int(o)) for b, x, y in zip(*(rows[c].to_pylist() for c in ("bucket", "keys", "ids")), strict=True) for k, o in zip(np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64), strict=True) if int(k) % 1000 == b)
    assert got == want and docs.num_rows == 3000
    assert rows.num_rows <= 1000 + len(want) // ngram_jaccard.ROW_KEYS
    copies = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts[:1] * 3000), pa.array([1] * 3000, pa.int64())], ["doc_id", "text", "tag"])
    out = pa.Table.from_batches(ngram_jaccard._emit(5, bands, 10, sent)(iter([copies])))
    assert max(Counter(out.filter(out["keys"].is_null())["bucket"].to_pylist()).values()) < 600


def test_queries_of_the_jaccard_join_have_few_shuffles(spark, monkeypatch):
    """Shuffles of one query run at once, each with a task for every partition, and the driver's memory bears them."""
    shuffles, kept = {}, ngram_jaccard.stage

    def counted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles[name] = max(shuffles.get(name, 0), len(re.findall(r"Exchange \w+", plan)))
        return kept(df, name)

    monkeypatch.setattr(ngram_jaccard, "stage", counted)
    monkeypatch.setattr(ngram_jaccard, "SMALL", 4)
    rng = random.Random(9)
    rows = [(k, t) for k, t in enumerate(t for n in (30, 12, 2) for t in _family(rng, n))]
    low = _classes(_sets(rows))
    got = ngram_jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), links=False).collect()
    assert {r.doc_id: r.component_id for r in got} == low
    assert max(shuffles.values()) <= 6, shuffles
