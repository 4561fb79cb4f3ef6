"""Operators of the subpackage against brute force on small tables with odd rows."""

import collections
import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxsieve.llm import chat_format, decontamination, near_dedup, pii, pieces, quality_classifier, quality_rules, sharding, substring_dedup, token_counts
from ctxsieve.llm.oracles import ORACLES
from ctxsieve.llm.queries import QUERIES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, words string, key long, row_id long"
BLANK = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    """Texts as documents, with more columns whose names an operator might use itself."""
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s" if i % 3 else None, "w", 7, 7) for i, t in enumerate(texts)], SCHEMA)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = say(120), say(50)
    texts = [base, base, base.upper(), base + " end", say(60) + "\n" + shared, shared + " \t" + say(40), say(200)]
    for _ in range(25):
        words = base.split()
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return [*texts, None, "", "   ", "one", "One", "a b c", "a b c", shared * 3, "x" * 5000, "é😀 漢 ▁ \x00 z", *[say(rng.randint(1, 30)) for _ in range(20)]]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).repartition(3).cache()


def test_substring_dedup(docs):
    rows, size = docs.collect(), 35
    words = {r.doc_id: re.findall(BLANK, r.text or "") for r in rows}
    seen = collections.Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    for r in substring_dedup.dedup_substrings(docs).collect():
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


def test_repeats_within_one_text(spark):
    text = " ".join(f"w{i % 40}" for i in range(120))
    got = substring_dedup.dedup_substrings(table(spark, [text, "short"])).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [120, 0]


def test_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_chat_format(spark):
    hostile = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile), (1, 0, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", "x\\h</turn>\n"), (1, 3, "assistant", "<|next|>####\\e"), (1, 4, None, "q"),
            (1, 5, "a: b", "\\c"), (2, None, "assistant", "😀"), (2, 2, "assistant", ""), (2, 2, "assistant", ""), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1)).withColumn("merged", F.lit(2))
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    got = chat_format.read_back(chat_format.format_chats(df)).collect()
    assert {g.conv_id for g in got} == set(want)
    for g in got:
        turns = sorted(want[g.conv_id])
        assert [tuple(t) for t in g.turns] == [t[1:] for t in turns]
        assert g.loss_texts == [x for _, r, x in turns if r == "assistant"]
        runs = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert g.formatted.count("</turn>\n") == runs == len(re.findall("^### ", g.formatted, re.M))


def test_long_chats(spark):
    rng = random.Random(5)
    rows = [(c, i, rng.choice(["user", "assistant"]) if c else "assistant", "é#" * rng.randint(0, 3)) for c in (0, 1) for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for g in chat_format.read_back(chat_format.format_chats(df)).collect():
        turns = [r[2:] for r in rows if r[0] == g.conv_id]
        assert [tuple(t) for t in g.turns] == turns
        assert g.loss_texts == [x for r, x in turns if r == "assistant"]


def test_token_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for small in (0, 1 << 16):
        for r in token_counts.count_tokens(docs, tokenizer(), limit=100, table_size=small).collect():
            n = len(model.encode(texts[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)
    for text in ["  a", "a ", " ", "a  b\n\n c", "<s> </s>", "▁x ▁▁y▁ z", "ﬁ́ \t"]:
        lengths = token_counts.Lengths({}, model.encode)
        assert lengths.count(text) == len(model.encode(text))


def test_frequent_pre_tokens_come_from_whole_texts(spark):
    late = ["filler " * 3000 + "late " * 5000, *["x y"] * 1500, "last " * 4000, "", None, "w" * 100]
    seen = collections.Counter(t for x in late if x for t in token_counts.pre_tokens(x) if len(t) <= token_counts.CACHE_CHARS)
    want = sorted(seen, key=lambda t: (-seen[t], t))
    for k in (0, 1, 2, 4, 100):
        table_ = token_counts.frequent_lengths(table(spark, late).repartition(3), tokenizer(), "text", k, 100)
        assert list(table_) == want[:k] and all(table_[t] == len(token_counts.load_model(tokenizer()).encode(t)) for t in table_)


def full_search(model, text):
    """Viterbi over a whole text at once."""
    own = "\uffff\uffff"  # a mark in the text
    symbols = [pieces.MARK if c == " " else own if c == pieces.MARK else c for c in " " + text]
    best = [(0.0, 0, ())] + [None] * len(symbols)
    for j in range(1, len(symbols) + 1):
        for i in range(max(0, j - model.longest), j):
            found = model.pieces.get("".join(symbols[i:j]))
            if found and (best[j] is None or best[i][0] + found[0] > best[j][0]):
                best[j] = (best[i][0] + found[0], i, (found[1],))
        one = symbols[j - 1]
        if one not in model.pieces and (best[j] is None or best[j - 1][0] + model.unknown > best[j][0]):
            best[j] = (best[j - 1][0] + model.unknown, j - 1, model.spell(pieces.MARK if one == own else one))
    out, j = [], len(symbols)
    while j:
        out.append(best[j][2])
        j = best[j][1]
    return [i for x in reversed(out) for i in x] if text else []


def test_pieces(docs):
    model = pieces.lexicon(tokenizer())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    encoded = pieces.encode_pieces(docs, tokenizer())
    for r in pieces.decode_pieces(encoded, tokenizer()).collect():
        assert r.ids == full_search(model, texts[r.doc_id]) and r.round_trip and r.text == texts[r.doc_id]
    long = "abc" * 400 + "漢字" * 100
    given = list(model.search(pieces.MARK + long))
    assert len(given) > 5 and [i for x in given for i in x] == full_search(model, long)


def odd_texts():
    """Many different words, some long, with unknown characters, marks, NULs and several spaces."""
    draw = random.Random(11)
    letters = "aaeeiinnsttthre" * 4 + "öß漢字ﬁ▁▁\0\t\n😀,.$*-0179\U0010ffff"
    word = lambda: "".join(draw.choices(letters, k=draw.choice([1, 2, 3, 5, 8, 13, 46, 47, 48, 49, 130])))
    texts = ["".join(draw.choice(["", " ", " ", "  ", "   "]) + word() for _ in range(60)) for _ in range(40)]
    return [*texts, "", " ", "   ", "▁", " ▁ ", "ﬁ" * 60, "a" * 200, "\0", texts[0]]


def test_new_words_are_searched_side_by_side(monkeypatch):
    """Of new short words no search of its own is made."""
    model = pieces.Lexicon(tokenizer())
    monkeypatch.setattr(model, "search", lambda text: pytest.fail(f"one by one: {text}"))
    words = ["".join(x) for x in itertools.product("abenost", repeat=4)]
    assert model.encode(" ".join(words)) == full_search(model, " ".join(words))


@pytest.mark.parametrize("few, entries", [(0, 200_000), (0, 100), (1 << 30, 100)])
def test_searches_agree(monkeypatch, few, entries):
    """One by one and side by side, with caches that hold all or little, in many portions."""
    for name, value in (("FEW", few), ("CACHE_ENTRIES", entries), ("_SIDE_BY_SIDE", 1000)):
        monkeypatch.setattr(pieces, name, value)
    model, texts = pieces.Lexicon(tokenizer()), odd_texts()
    for _ in range(2):
        for text, ids in zip(texts, model.encode_all(texts)):
            ids = np.frombuffer(ids, "<i4").tolist()
            assert ids == full_search(model, text) and model.decode(ids) == text
        assert len(model.cache) <= entries and all(len(x) <= pieces.CACHE_CHARS for x in model.cache)
    assert model.encode_all([]) == []


def test_searches_agree_on_ties_and_without_byte_pieces():
    """A small lexicon with equal paths and nothing to write unknown characters with."""
    draw = random.Random(3)
    model = pieces.Lexicon(tokenizer())
    parts = {"a": -1.0, "b": -1.0, "ab": -2.0, "aba": -3.0, "ba": -2.0, "bb": -1.5, "▁": -1.0, "▁a": -2.0, "abab": -4.0, "cd": -0.5}
    model.pieces = {x: (score, i) for i, (x, score) in enumerate(parts.items(), 1)}
    model.steps, model.bytes, model.unknown_id, model.unknown, model.longest, model.trie = pieces._Steps(model.pieces), {}, 0, -14.0, 4, {}
    for x, found in model.pieces.items():
        node = [model.trie, 0.0, None]
        for c in x:
            node = node[0].setdefault(c, [{}, 0.0, None])
        node[1:] = found
    texts = ["▁" + "".join(draw.choices("aabbcd", k=draw.randrange(30))) for _ in range(300)] + ["", "c", "▁"]
    for text, ids in zip(texts, model.search_all(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == [i for x in model.search(text) for i in x]


@pytest.mark.parametrize("limit", [32 << 20, 2000, 0])
def test_decontamination(spark, docs, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "_PART", 5)  # the commonest words are dealt to several parts
    texts = corpus()
    items = [(1, " ".join(texts[0].split()[20:45])), (2, "ONE"), (3, None), (4, ""), (None, "B! c"), (5, "B! c"), (6, "nowhere to be found")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)).withColumn("token", F.lit("x"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("null" if k is None else str(k))
    want = {}
    for r in docs.collect():
        w, hit, found = split(r.text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        want[r.doc_id] = (len(w), len(hit), sorted(found))
    got = decontamination.find_contamination(docs, benchmark, broadcast_bytes=limit).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want
    clean = decontamination.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, v in want.items() if not v[1]}


def groups(rows, k, percent=80):
    sets = {}
    for r in rows:
        w = [x.translate(LOWER) for x in re.findall(BLANK, r.text or "")]
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_near_dedup(docs):
    want = groups(docs.collect(), 4)
    got = near_dedup.near_duplicates(docs, shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.drop_near_duplicates(docs, shingle=4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}


def test_drop_keeps_one_row_of_each_group_under_null_and_repeated_ids(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(20))
    alone = [(None, say("a")), (None, say("b")), (5, say("c")), (5, say("d")), (None, None), (5, ""), (5, None)]
    copies = [(None, say("e")), (None, say("e")), (5, say("f")), (5, say("f")), (None, say("g")), (8, say("g")), (5, say("g") + " end")]
    df = spark.createDataFrame(alone + copies, "doc_id long, text string").repartition(3)
    key = lambda rows: collections.Counter((r[0], r[1]) for r in rows)
    want = key(alone + [(None, say("e")), (5, say("f")), (5, say("g") + " end")])
    assert key(near_dedup.drop_near_duplicates(df, shingle=4).collect()) == want


def test_large_bucket_of_near_copies(spark):
    """Copies of one text, edited so that about half of the pairs are linked."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = table(spark, texts)
    want = groups(df.collect(), 4)
    got = near_dedup.near_duplicates(df, shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and 1 < len({c for _, c in want.values()}) < 150


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        w = re.findall(BLANK, text)
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(BLANK, x)]
        g = got[r.doc_id]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (g.base_failed and g.kept)


def test_votes():
    fitted = quality_rules.fit_votes({"ggg": 900, "bgg": 40, "gbg": 30, "-gg": 30}, 3)
    assert fitted["ggg"] > 0.9 and fitted["-gg"] > 0.5 > max(fitted["bgg"], fitted["gbg"])
    assert quality_rules.fit_votes({}, 3) == {}


def base_spans(s):
    luhn = lambda q: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(q[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s):
        q = re.sub("[ -]", "", m.group())
        if 12 <= len(q) <= 19 and luhn(q):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15])


def test_pii_base():
    rng = random.Random(4)
    parts = ["a@b.c", "x_y@z", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "((", "7", " ", "é", "-", "_", "0.0.0.0.0.0.0.0", "b.c_d@e.f", "٣"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(s) == base_spans(s), s


def test_pii_counts_of_each_kind(spark, tmp_path):
    """All columns of the contract against brute force, in rows where a kind's number and a span's place differ."""
    ip, card, phone, mail = "10.0.0.1", "4111 1111 1111 1111", "+1 (988) 555-2485", "a@b.co"
    texts = [phone, f"{phone} or {phone}", f"{ip}, {ip}, {mail}", f"{card}; {mail}", f"{mail} {ip} {card}; {phone}", f"é {mail} {mail} {mail}", "none", "", None, "300.1.1.1 4111-1111-1111-1112"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in QUERIES["op8_pii"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i] == (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(said.encode()).hexdigest()), text


def test_pii_bootstrap(spark):
    texts = [f"please write to mail: a{k}@x.org today" for k in range(12)] + ["please write to mail: user-99812x today", "see id user-99812x now", None, ""]
    df = table(spark, texts)
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert [tuple(s) for s in got[12].spans] == [(22, 4, 33)] and got[12].base == [] and got[13].spans == [] and got[14].spans == []
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "please write to mail: <EMAIL> today" and clean[12] == "please write to mail: <ID> today" and clean[14] is None and clean[13] == texts[13]


def test_quality_classifier(spark):
    rng = random.Random(2)
    words = ["river", "garden", "stone", "bridge", "light", "paper", "seven", "window"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts, labels = [], []
    for i in range(400):
        kind = i % 4
        text = say(40) + ("." if kind < 2 else " $$$ %%% &&& ###" * 5 if kind == 2 else " moron trash")
        texts.append(text)
        labels.append((i, int(kind != 2), int(kind == 3)))
    df = table(spark, [*texts, None, ""])
    train = spark.createDataFrame([x for x in labels if x[0] % 8 < 4] + [(None, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify_quality(df, train).collect()}
    held = [x for x in labels if x[0] % 8 >= 4]
    assert sum(got[d].kept == (q == 1 and t == 0) for d, q, t in held) >= 0.95 * len(held) and len(got) == 402
    assert all(0 < r.p_path < 1 for r in got.values())
    none = train.where("false")
    assert quality_classifier.drop_low_quality(df, none).count() == 402


def test_shrinking(spark):
    """A site of one document stays near the global share; a large one goes its own way."""
    texts = ["river garden stone " * 10] * 40
    df = table(spark, texts)
    train = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify_quality(df, train, host=F.when(F.col("doc_id") == 0, "one").otherwise("many")).select("host", "p_host").distinct().collect()
    assert all(abs(r.p_host - 0.5) < 0.2 for r in got)


def jumped(key, n):
    b = j = 0
    b = -1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs):
    import zlib

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k")).collect()
    want = {r.doc_id: (jumped(r.k & (2**64 - 1), 8), jumped(r.k & (2**64 - 1), 9), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows}
    slots = collections.defaultdict(list)
    for r in sharding.shard_manifest(docs).collect():
        assert (r.shard, r.grown_shard, r.size, r.text_crc32) == want[r.doc_id] and r.grown_shard in (r.shard, 8) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    twice = spark.createDataFrame([(None, "a"), (5, None), (5, "b")], "doc_id long, text string")
    got = sharding.shard_manifest(twice).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3


def test_empty_tables(spark):
    none = table(spark, ["x"]).where("false")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert decontamination.find_contamination(none, benchmark).count() == 0
    assert decontamination.find_contamination(table(spark, ["a b"]), benchmark.where("false")).first().n_hit == 0
    assert quality_rules.judge_quality(none).count() == 0
    assert pii.find_pii(none).count() == 0 and pii.redact(none).count() == 0
    assert token_counts.count_tokens(none, tokenizer()).count() == 0
    assert pieces.encode_pieces(none, tokenizer()).count() == 0
    assert sharding.shard_manifest(none).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_json_of_plan_has_no_python_in_native_operators(docs):
    for df in (decontamination.find_contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text")), quality_rules.counted(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), json.dumps(plan[:500])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    import compare

    data = "/root/testdata/sf0.001"
    assert compare.difference(QUERIES[name](spark, data), compare.connect(data), ORACLES[name]) == ""


def thue_morse(n):
    """A word over two letters, and its complement; polynomial hashes modulo powers of two take them for equal."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_some_hashes_take_for_equal(spark, n):
    one, two = thue_morse(n)
    plain = " ".join(f"w{i}" for i in range(17))
    df = table(spark, [one, two, *(f"{plain} {x} {plain}" for x in (one, two)), " ".join(one), " ".join(two)])
    words = [substring_dedup.dedup_substrings(df.where(f"doc_id in ({a}, {a + 1})")).orderBy("doc_id").collect() for a in (0, 2)]
    assert [r.n_removed for pair in words for r in pair] == [0, 0, 0, 0]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df.where("doc_id < 4"), shingle=1, percent=100).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def joined(spark, texts):
    """Documents as the result of a join and a shuffle, not cached, with columns that operators might use themselves."""
    left = table(spark, texts).withColumn("_row", F.col("doc_id") * 10).withColumn("_first", F.lit("f"))
    right = spark.createDataFrame([(i, f"x{i}") for i in range(len(texts))], "doc_id long, shard string")
    return left.join(right.repartition(7), "doc_id").repartition(5)


def test_results_go_to_their_own_rows(spark):
    texts = corpus()
    df, plain = joined(spark, texts), table(spark, texts).cache()
    benchmark = spark.createDataFrame([(1, " ".join(texts[0].split()[20:45]))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    whole = lambda out: sorted((r.doc_id, r.text or "", r._row, r._first, r.shard) for r in out.collect())
    ids = lambda out: {r.doc_id for r in out.collect()}
    for run in (lambda d: decontamination.drop_contaminated(d, benchmark), lambda d: near_dedup.drop_near_duplicates(d, shingle=4), lambda d: quality_classifier.drop_low_quality(d, labels)):
        out = run(df)
        assert out.columns == df.columns and {r[0] for r in whole(out)} == ids(run(plain))
        assert all(r[2] == 10 * r[0] and r[1] == (texts[r[0]] or "") and r[4] == f"x{r[0]}" for r in whole(out))
    seeds = [f"{t or ''} mail a{i}@x.org" for i, t in enumerate(texts)]
    out = pii.redact(joined(spark, seeds))
    assert all(r.text == seeds[r.doc_id].replace(f"a{r.doc_id}@x.org", "<EMAIL>") and r._row == 10 * r.doc_id for r in out.collect())
    slots = sharding.shard_manifest(df).collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(texts)


def test_large_bucket_blocks(spark, monkeypatch):
    """All paths over buckets: pivots, small buckets, blocks of large ones, and what is left of those."""
    monkeypatch.setattr(near_dedup, "_SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "_TEXTS", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(130):
        words = list(base)
        for _ in range(rng.choice([1, 2, 5, 6, 7])):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = table(spark, texts)
    want = groups(df.collect(), 4)
    got = near_dedup.near_duplicates(df, shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_pii_rounds_by_hand(spark):
    rng = random.Random(6)
    links = [(f"p{rng.randrange(8)}", f"i{rng.randrange(30)}") for _ in range(120)]
    seeds = {f"i{k}" for k in range(0, 30, 2)}
    edges = set(links)
    score = {i: float(i in seeds) for _, i in edges}
    for _ in range(3):
        rated = {}
        for p in {p for p, _ in edges}:
            mine = [i for q, i in edges if q == p]
            rated[p] = (sum(score[i] for i in mine) / (len(mine) + 1.0), sum(i in seeds for i in mine))
        trusted = {p: c for p, (c, n) in rated.items() if c >= 0.5 and n >= 3}
        for i in score:
            miss = 1.0
            for p, j in edges:
                if j == i and p in trusted:
                    miss *= max(1 - trusted[p], 1e-6)
            score[i] = max(float(i in seeds), 1 - miss)
    df = spark.createDataFrame([(p, i, i in seeds) for p, i in links], "pattern string, instance string, seed boolean")
    got = {r.pattern: r.confidence for r in pii.trusted_patterns(df, least_confidence=0.5).collect()}
    assert trusted and got.keys() == trusted.keys() and all(abs(got[p] - trusted[p]) < 1e-9 for p in got)


def test_pii_finds_secrets(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(6)]
    texts = [f'so the token = "{h}"### 4785380592391139$$$ de' for h in hexes] + ['my token = "a1b2c3"', "call phone: 555 123 4567 now", *(f"phone: +1 (988) 555-24{k}5 x" for k in range(5)), "x" * 100_000 + "漢" * 100_000 + "1"]
    got = {r.doc_id: [(texts[r.doc_id][s.start : s.end], s.kind) for s in r.spans if s.kind == 4] for r in pii.find_pii(table(spark, texts)).collect()}
    assert all(got[i] == [(h, 4)] for i, h in enumerate(hexes)) and got[6] == [("a1b2c3", 4)] and got[7] == [("555 123 4567", 4)] and got[13] == []


def test_site_priors_by_hand(spark):
    rng = random.Random(9)
    texts = ["river garden stone " * 8 + ("$$$ %%%" * 6 if rng.random() < (0.8 if i % 5 == 0 else 0.2) else "") for i in range(300)]
    rows = [(i, t, f"p{i % 3}", f"h{i % 5}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("$" not in texts[i]), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify_quality(df, labels).collect()
    base = sum("$" in texts[i] for i in range(0, 300, 2)) / 150
    shift = math.log(base / (1 - base))
    x = {r.doc_id: 1 / (1 + math.exp(-r.added - shift)) for r in got}
    n, mean = len(x), sum(x.values()) / len(x)
    by = lambda key: {k: [x[r.doc_id] for r in got if key(r) == k] for k in {key(r) for r in got}}
    hosts, paths = by(lambda r: r.host), by(lambda r: (r.host, r.path))
    avg = lambda v: sum(v) / len(v)

    def strength(groups, parent, above, spread):
        v = sum((y - avg(g)) ** 2 for g in groups.values() for y in g) / (n - len(groups))
        t = (sum(len(g) * (avg(g) - parent(k)) ** 2 for k, g in groups.items()) - (len(groups) - above) * v) / spread
        return min(1e6, max(1.0, v / t)) if t > 0 else 1e6

    a = strength(hosts, lambda k: mean, 1, n - sum(len(g) ** 2 for g in hosts.values()) / n)
    b = strength(paths, lambda k: avg(hosts[k[0]]), len(hosts), n - sum(len(g) ** 2 / len(hosts[k[0]]) for k, g in paths.items()))
    for r in got:
        p_host = (sum(hosts[r.host]) + a * mean) / (len(hosts[r.host]) + a)
        own = paths[r.host, r.path]
        p_path = (sum(own) + b * p_host) / (len(own) + b)
        odds = math.log(p_path / (1 - p_path)) + r.added
        assert abs(r.p_host - p_host) < 1e-6 and abs(r.p_path - p_path) < 1e-6 and abs(r.p_reject - 1 / (1 + math.exp(-odds))) < 1e-6
        assert r.kept == (r.p_reject < 0.5)


def test_classifier_on_odd_tables(spark):
    df = spark.createDataFrame([(5, f"word {i % 7} more") for i in range(200)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 0, 0), (5, None, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit_evidence(df, labels, "doc_id", "text", 10, 10) is not None
    assert quality_classifier.classify_quality(df, labels).count() == 201
    assert quality_classifier.classify_quality(df.where("false"), labels).count() == 0


def test_held_out_labels(spark):
    """Fitted on the labels of even ids, judged on those of odd ids of the tables."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.kept for r in quality_classifier.classify_quality(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(r.doc_id, r.quality == 1 and r.toxic == 0) for r in labels.where("doc_id % 2 = 1").dropDuplicates(["doc_id"]).collect() if r.doc_id in got]
    good = [d for d, ok in held if ok]
    assert sum(got[d] for d in good) >= 0.95 * len(good) and sum(got[d] == ok for d, ok in held) >= 0.9 * len(held)


def test_quality_verdicts_by_hand(docs):
    """Votes recomputed from the texts, and expectation-maximisation over documents instead of patterns."""
    import numpy as np

    got = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    names, votes = [], []
    for r in docs.collect():
        text, g = r.text or "", got[r.doc_id]
        n, letters = max(1, g.n_words), max(1, g.word_chars)
        lines = [x for x in text.split("\n") if re.search(BLANK, x)]
        upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
        pick = lambda bad, good: "b" if bad else "g" if good else "-"
        mine = "".join([
            pick(g.n_words < 10, g.n_words >= 50), pick(letters < 2 * n or letters > 15 * n, 3 * n <= letters <= 10 * n), pick(10 * g.n_symbols > n, 100 * g.n_symbols <= n),
            pick(2 * g.n_dup_lines > len(lines), g.n_dup_lines == 0 and len(lines) > 1), pick(100 * g.n_repeat_words > 20 * n, 100 * g.n_repeat_words <= 5 * n), pick(2 * upper > letters, 5 * upper <= letters)])
        assert mine == g.votes
        names.append(r.doc_id)
        votes.append(mine)
    k = 6
    bad, voted = (np.array([[v in x for v in row] for row in votes], float) for x in ("b", "bg"))
    share = np.array([0.85] + [0.15 / k] * k)
    alarm = np.vstack([np.full(k, 0.005), np.where(np.eye(k) > 0, 0.7, 0.1)])

    def posterior():
        logs = np.log(share) + bad @ np.log(alarm).T + (voted - bad) @ np.log(1 - alarm).T
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for _ in range(50):
        p = posterior()
        mass = p.sum(0) + 0.5
        share = mass / mass.sum()
        alarm = (p.T @ bad + 0.05) / (p.T @ voted + 0.1)
        alarm[1:] = np.where(np.eye(k) > 0, np.maximum(alarm[1:], 0.5), alarm[1:])
        alarm = np.clip(alarm, 0.002, None)
        alarm[0], alarm[1:] = np.minimum(alarm[0], 0.01), np.minimum(alarm[1:], 0.995)
    for d, p in zip(names, posterior()[:, 0]):
        assert abs(got[d].p_good - p) < 1e-6 and got[d].kept == (not got[d].base_failed and got[d].p_good >= 0.5)


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages(spark, pipeline, tmp_path):
    """Each stage against brute force over what its predecessor kept."""
    data = "/root/testdata/sf0.001"
    before, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    columns = before.columns
    for name, stage in pipeline.STAGES:
        stage(spark, before, data).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in after.collect()}
        texts = {r.doc_id: r.text for r in before.collect()}
        assert kept[name].keys() <= texts.keys() and (name == "pieces" or after.columns == columns)
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
            good = [d for d in texts if labels.get(d)]
            assert sum(d in kept[name] for d in good) >= 0.95 * len(good)
        elif name == "near_dedup":
            want = groups(before.collect(), 5)
            assert kept[name].keys() == {d for d, (_, c) in want.items() if d == c}
        elif name == "decontamination":
            split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
            items = [split(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
            sizes = {len(w) for w in windows}
            dirty = lambda w: any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
            assert kept[name].keys() == {d for d, t in texts.items() if not dirty(split(t))}
        elif name == "pii":
            assert kept[name].keys() == texts.keys() and not any(base_spans(r.text or "") for r in kept[name].values())
            assert all(r.text == texts[d] for d, r in kept[name].items() if not re.search("[0-9@]", texts[d] or ""))
        else:
            model = pieces.lexicon(tokenizer())
            assert all(r.ids == model.encode(texts[d] or "") and r.round_trip for d, r in kept[name].items())
        before = after
    assert {r.doc_id for r in pipeline.run(spark, data).collect()} == kept["pieces"].keys()


def test_pipeline_on_odd_rows(spark, pipeline, tmp_path):
    """Null texts and ids, empty and repeated rows, and no rows at all pass through every stage."""
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, ""), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "i j k l m n o p q")], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    for rows in (odd.select(docs.columns), docs.where("false")):
        out = rows
        for i, (_, stage) in enumerate(pipeline.STAGES):
            place = str(tmp_path / f"{rows is odd}-{id(rows)}-{i}")
            stage(spark, out, data).write.parquet(place)
            out = spark.read.parquet(place)
        assert out.count() <= rows.count()


@pytest.mark.parametrize("few", [0, 60_000])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    near_dedup.ship(spark)
    draw = random.Random(5)
    old = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(200, 201), (201, 202), (202, 203), (200, 203)]
    new = [(draw.randrange(150), draw.randrange(150)) for _ in range(15)] + [(203, 300), (300, 301)]

    def groups(links):
        sets = []
        for a, b in ((a, b) for a, b in links if a != b):
            met = [s for s in sets if a in s or b in s]
            sets = [s for s in sets if s not in met] + [set().union({a, b}, *met)]
        return {frozenset(s) for s in sets}

    def found(labels):
        of = {}
        for node, component in labels.collect():
            of.setdefault(component, set()).add(node)
        assert all(c in s for c, s in of.items())
        return {frozenset(s) for s in of.values()}

    table = lambda links: spark.createDataFrame(links, "a long, b long")
    labels, n = near_dedup._labelled(table(old))
    assert found(labels) == groups(old) and n == labels.count()
    more, m = near_dedup._joined(labels, n, table(new))
    assert found(more) == groups(old + new) and m == more.count()
    same, k = near_dedup._joined(more, m, table(old[:3]))
    assert found(same) == groups(old + new) and k == m
    none, zero = near_dedup._labelled(table([]))
    assert none.count() == zero == 0
