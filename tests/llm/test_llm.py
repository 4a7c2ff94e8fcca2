"""The training-data operators against brute force, round trips, held-out accuracy, and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinspark.llm import chat_format, exact_dedup, fingerprints, lm_score, ngram_join, packing, piece_codec, quality, suffix_dedup, toxicity
from twinspark.llm.shared import components

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, score double, row long, label int, h1 long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows (id, text) with extra columns, null or not, that share names with the operators' own."""
    return spark.createDataFrame([(i, t, None, 0.5, 7, None, None, 3) for i, t in rows], DOC)


def odd():
    rng = random.Random(4)
    words = ["the", "Ünder", "a", "日本", "x" * 50, "idiot", "▁", "don't", "🙂"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(6000)
    near = long.split(" ")
    near[100] = "changed"
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, long), (6, long), (6, long), (7, " ".join(near)), (None, "no id here at all today"), (9, text(40)), (10, "a\x00b  c d"), (11, "two words"), (12, "two words"), (13, "two  words")]


@pytest.fixture(scope="module")
def frame(spark):
    return docs(spark, odd()).persist()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_piece_codec(spark, frame):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in piece_codec.round_trip(frame, PIECES).collect():
        ids = [library.encode(t or "") for i, t in odd() if i == r["doc_id"]][0]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    own = piece_codec.PieceCodec(PIECES)
    for n in (2, 3, 7, 16, 17, 33, 100, 5000):
        for end in ("", "the end", "x", "\n", ".  b"):
            assert own.encode("a" + " " * n + end) == library.encode("a" + " " * n + end)
    assert piece_codec.round_trip(docs(spark, [(1, " " * 200_000 + "x")]), PIECES).first()["n_tokens"] == len(library.encode(" " * 200_000 + "x"))
    coded = piece_codec.encode_documents(frame.where("doc_id = 9"), PIECES)
    assert piece_codec.decode_documents(coded, PIECES).first()["text"] == library.decode(library.encode(dict(odd())[9]))
    assert piece_codec.round_trip(frame.where("false"), PIECES).count() == 0


def test_short_words_share_one_table(spark, monkeypatch):
    """Words of up to SHORT characters are coded many at a time, none by itself; small lots and a cache that is always full change nothing."""
    rng, library = random.Random(9), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    parts = [*map(chr, range(33, 127)), "\n", "\x00", "\x1c", "\xa0", "é", "ß", "日", "本", "e\u0301", "🙂", "\U0001f9ff", "\ufffd", "<s>", "<unk>", "<0x0A>", "the", "tion", "ing", "ation", ".\n"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    words += [c * n for c in ("a", "é", "🙂", "the", "\n") for n in (1, 2, 5, 12)] + ["a" * 63, "x" * 64, "日" * 63, "🙂" * 65]
    monkeypatch.setattr(piece_codec, "LOT", 100, raising=False)
    for most in (10, 400_000):
        own, single = piece_codec.PieceCodec(PIECES, most), []
        monkeypatch.setattr(own, "_ids_of_chunk", lambda c, f=own._ids_of_chunk: single.append(c) or f(c))
        texts = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
        for lo in (0, 50, 0):
            some = texts[lo : lo + 300]
            for text, (n, ids, back) in zip(some, piece_codec.coded(pa.array(some), own), strict=True):
                want = library.encode(text)
                assert (n, ids, back) == (len(want), ",".join(map(str, want)), library.decode(want))
        assert [n for n, _, _ in piece_codec.coded(pa.array(texts), own)] == [len(library.encode(t)) for t in texts]
        assert {len(c) for c in single} == {65, 66}


def test_word_tokens_equal_the_library():
    """Latin-1 words take a shorter way; a bound of one piece makes every call start afresh."""
    rng, plain = random.Random(7), [chr(c) for c in (*range(33, 127), *range(0xA1, 0x100))]
    mixed = [*plain, "'s", "'LL", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "日", "e\u0301", "İ", "ŉ", "\x00", "\x1c", "\x85", "\xa0", "🙂"]
    words = list(dict.fromkeys([*mixed, *("".join(rng.choice(a) for _ in range(rng.randint(1, 9))) for a in (plain[:94], plain, mixed) for _ in range(1500))]))
    library = Tokenizer.from_file(WORDS)
    want = [np.asarray(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    for most in (1, 300_000):
        tokens = packing.WordTokens(WORDS, most)
        assert [x for k in range(0, len(words), 1000) for x in tokens.ids(words[k : k + 1000])] == want


def test_packing(spark, frame):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(frame, WORDS, group_tokens=9000).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, t in odd():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert sum(r["length"] for r in pieces[i]) == len(ids) * sum(x == i for x, _ in odd())
        for r in pieces[i]:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048
    assert packing.pack_documents(frame.where("false"), WORDS).count() == 0


def test_exact_dedup(spark, frame):
    got = exact_dedup.exact_dedup(frame, digest=True).collect()
    assert len(got) == len(odd())
    r = {x["doc_id"]: x for x in got}
    assert r[1]["keep_id"] == 3 and r[3]["kept"] and r[2]["group_size"] == 3
    assert r[12]["keep_id"] == 13 and r[13]["group_size"] == 3
    assert r[5]["kept"] and r[5]["group_size"] == 3 and sum(x["kept"] for x in got if x["doc_id"] == 6) == 0
    assert sum(x["kept"] for x in got) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in odd()})
    assert r[4]["text_sha256"] == hashlib.sha256(b"one").hexdigest()
    assert exact_dedup.keep_first_copies(frame).columns == frame.columns
    assert exact_dedup.exact_dedup(frame.where("false")).count() == 0


def shingled(text):
    w = WORD.findall(text or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [3, 4096])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rng = random.Random(8)
    rows = odd()
    for g in range(6):
        base = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(120)]
        for k in range(7):
            now = list(base)
            for _ in range(k):
                now[rng.randrange(120)] = "new"
            rows.append((100 + g * 10 + k, " ".join(now)))
    got = ngram_join.similar_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = [shingled(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    want = sorted((i or 0, links[k], sum(x == root[k] for x in root)) for k, (i, _) in enumerate(rows))
    assert sorted((r["doc_id"] or 0, r["n_links"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(root))
    assert ngram_join.similar_documents(docs(spark, rows).where("false")).count() == 0
    assert ngram_join.keep_one_of_each(docs(spark, rows)).columns == DOC.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ")


def test_posterior_keeps_pairs_at_the_threshold():
    for n, least in zip(ngram_join.LOOKS, ngram_join.least_matches(0.8, 1e-7), strict=True):
        lost = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert lost < 1e-6 and least_is_needed(n, least)


def least_is_needed(n, least):
    return least < 0.8 * n


@pytest.mark.parametrize("most", [0, 2000])
def test_repeated_passages(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_REGIONS", most)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, other, loop = noise(700), noise(380), "ab" * 450
    rows = [*odd(), (20, noise(300) + shared + noise(200)), (21, shared[50:] + noise(90)), (22, noise(10) + shared[:500] + noise(600) + shared[100:]), (23, other), (24, other), (25, loop), (26, noise(2000)), (27, shared[:600])]
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(x[k : k + 400] for x in texts for k in range(len(x) - 399))
    want = []
    for (i, _), x in zip(rows, texts, strict=True):
        cover = np.zeros(len(x) + 1, int)
        for k in range(len(x) - 399):
            if seen[x[k : k + 400]] > 1:
                cover[k] += 1
                cover[k + 400] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        want.append((i or 0, len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    frame = docs(spark, rows)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed_passages(frame).collect())
    assert got == sorted(want)
    cut = suffix_dedup.without_passages(frame)
    assert cut.columns == frame.columns and cut.count() == len(rows)
    assert suffix_dedup.removed_passages(frame.where("false")).count() == 0


def test_repeated_passages_beyond_16_mib_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_REGIONS", 0)
    noise = np.random.default_rng(3).integers(97, 123, (1 << 24) - 300).astype(np.uint8).tobytes().decode()
    rows = [(1, noise + "ab" * 275), (2, "ab" * 203 + "xyz" * 20), (3, "q" * 30 + "ab" * 202)]
    got = suffix_dedup.removed_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got} == {1: (550, 1), 2: (406, 1), 3: (404, 1)}


@pytest.mark.parametrize("places", [8, 64])
def test_least_places_are_the_first_of_equals_in_any_part(monkeypatch, places):
    monkeypatch.setattr(suffix_dedup, "PLACES", places)
    rng = np.random.default_rng(4)
    for n in range(5, 150):
        x = rng.integers(0, 4, n).astype(np.uint64) << np.uint64(40)
        assert suffix_dedup._least_places(x, 5).tolist() == [k + int(np.argmin(x[k : k + 5])) for k in range(n - 4)]


def test_suffix_sort_finds_all_equal_starts():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 99, 300), np.tile([97, 98, 97], 60)]).astype(np.uint8)
    start = np.arange(len(data) - 12)
    group = rng.integers(0, 2, len(start))
    count = collections.Counter((g, data[s : s + 12].tobytes()) for s, g in zip(start, group, strict=True))
    want = np.array([count[g, data[s : s + 12].tobytes()] > 1 for s, g in zip(start, group, strict=True)])
    assert (suffix_dedup.repeated_starts(data, start, group, 12) == want).all()


def test_fingerprints(spark, frame):
    got = fingerprints.compare_with_edited(frame).collect()
    assert len(got) == len(odd())
    order = sorted(((i, t or "") for i, t in odd() if i is not None), key=lambda x: -x[0])
    r = {x["doc_id"]: x for x in got}
    i, t = order[0]
    edited = t[: len(t) - len(t) // 2] + order[1][1][: len(t) // 2]
    assert r[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r[i]["n_chars"] == len(t)
    assert r[None]["edited_sha256"] == hashlib.sha256((dict(odd())[None][:12] + order[0][1][:11]).encode()).hexdigest()
    assert r[5]["fingerprint"] == r[6]["fingerprint"] and r[1]["fingerprint"] == r[2]["fingerprint"] == "00" * fingerprints.SLOTS
    near = {x["doc_id"]: x["class_id"] for x in fingerprints.near_documents(frame).collect()}
    assert near[5] == near[6] == near[7] == 5 and near[9] == 9
    assert fingerprints.compare_with_edited(frame.where("false")).count() == 0


def test_fewer_edits_are_nearer():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ij") for _ in range(3000))
    likeness = []
    for n in (0, 5, 30, 200):
        now = list(text)
        for _ in range(n):
            now[rng.randrange(len(now))] = "z"
        a, b = fingerprints.embed([text, "".join(now)])
        likeness.append((a == b).mean())
    assert likeness[0] == 1 and likeness == sorted(likeness, reverse=True) and likeness[1] > 0.8 > 0.4 > likeness[3]


def read_by_walk(text):
    """What a walk reads, step by step, and the fingerprint, by their definitions."""
    of, read, i = fingerprints.points(text), [], 0
    chars = fingerprints.characters(of)
    while i < len(chars):
        read.append(int(of[i]))
        i += fingerprints._STAYS[chars[i]][(len(read) - 1) % fingerprints.PERIOD] == 1
    slots = []
    for slot, positions in enumerate(fingerprints._AT.tolist()):
        taken = [p for p in positions if p < len(read)]
        slots.append(fingerprints.values(np.array([read[taken[-1]]]), np.array([slot]))[0] if taken else 0)
    return read, bytes(slots).hex()


def test_fingerprints_equal_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edited(frame).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), reverse=True)
    assert len(got) == len(rows)
    prints = {i: read_by_walk(t)[1] for i, t in rows}
    alike = lambda a, b: np.mean([a[k : k + 2] == b[k : k + 2] for k in range(0, len(a), 2)])
    for k, (i, t) in enumerate(rows):
        j, u = rows[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        changed, r = read_by_walk(edited)[1], got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == prints[i] and r["edited_fingerprint"] == changed
        assert r["near_edited"] == alike(prints[i], changed) and r["near_next"] == alike(prints[i], prints[j])


def test_any_changed_character_changes_the_embedding():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ij") for _ in range(400))
    whole = read_by_walk(text)[0]
    assert all(read_by_walk(text[:k] + "Z" + text[k + 1 :])[0] != whole for k in range(len(text)))


def test_no_two_characters_are_taken_for_each_other():
    """Replacing every one of a character by another changes about all slots that read it, whichever the two are."""
    rng = random.Random(4)
    plain = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), 0x4E2D, 0x65E5, 0x1F642, 0x1F643)]
    rows = [fingerprints.characters(fingerprints.points(c))[0] for c in plain[:-4]]
    assert len(set(rows)) == len(rows)
    of, slots = fingerprints.points("".join(plain)), np.arange(fingerprints.SLOTS)
    as_bytes = np.stack([fingerprints.values(np.full(fingerprints.SLOTS, p), slots) for p in of])
    alike = (as_bytes[:, None, :] == as_bytes[None, :, :]).mean(axis=2) - np.eye(len(of))
    assert alike.max() < 0.05 and as_bytes.min() > 0
    changed = 0
    for _ in range(300):
        a, b = rng.sample(plain, 2)
        text = "".join(rng.choice([a, *"the of and"]) for _ in range(400))
        x, y = fingerprints.embed([text, text.replace(a, b)])
        changed += (x != y).any()
    assert changed >= 299


def test_near_documents_find_like_fingerprints(spark):
    """Ids divisible by 100 against all rows of sf0.01: links of at least 0.8 that brute force finds, and no class without a chain of links."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in frame.collect())
    rng = random.Random(4)
    for k in range(0, 60, 5):  # near copies of rows of the query set
        now = list(rows[k][1])
        for _ in range(len(now) // 800):
            now[rng.randrange(len(now))] = "#"
        rows.append((10_000 + rows[k][0], "".join(now)))
    slots = fingerprints.embed([t for _, t in rows])
    near = {r["doc_id"]: r["class_id"] for r in fingerprints.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == len(rows)
    found = linked = 0
    for k, (i, _) in enumerate(rows):
        if i % 100 == 0 or i >= 10_000:
            for other in np.flatnonzero((slots == slots[k]).mean(axis=1) >= 0.8):
                linked += rows[other][0] != i
                found += rows[other][0] != i and near[rows[other][0]] == near[i]
    assert linked >= 10 and found >= 0.9 * linked


@pytest.mark.parametrize("block", [2, 2048])
def test_near_documents_compares_all_pairs_of_a_band(spark, monkeypatch, block):
    """Fingerprints that share a band with a lower id unlike them are still linked with each other: as brute force says."""
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", block)
    monkeypatch.setattr(fingerprints, "BAND", 4)
    monkeypatch.setattr(fingerprints, "BANDS", 3)
    monkeypatch.setattr(fingerprints, "_BAND", np.arange(12).reshape(3, 4))
    rng = random.Random(21)
    value = lambda: rng.randrange(1, 256)
    prints = [[7] * 4 + [value() for _ in range(fingerprints.SLOTS - 4)] for _ in range(9)]
    for base in prints[1:]:
        now = list(base)
        now[5], now[9] = 256 - now[5], 256 - now[9]  # alike, but with no other band in common
        prints.append(now)
    rows = [(i, bytes(p).hex()) for i, p in enumerate(prints)]
    monkeypatch.setattr(fingerprints, "fingerprint_documents", lambda docs, text: spark.createDataFrame(rows, "doc_id long, fingerprint string"))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sum(x == y for x, y in zip(prints[a], prints[b], strict=True)) >= 0.8 * fingerprints.SLOTS:
                root = [min(root[a], root[b]) if v in (root[a], root[b]) else v for v in root]
    assert len(set(root)) == 9
    assert {r["doc_id"]: r["class_id"] for r in fingerprints.near_documents(None).collect()} == dict(enumerate(root))


def test_walks_read_whole_texts():
    """Edits of the last characters change the fingerprint about as often as those of the first."""
    seen = []
    for c in "abcdefgh":
        text = c * 96
        got = fingerprints.embed([text, *(text[:k] + "#" + text[k + 1 :] for k in range(len(text)))])
        seen.append((got[1:] != got[0]).any(axis=1))
    head, tail = (np.stack(seen)[:, part].mean() for part in (slice(30), slice(66, None)))
    assert tail > 0.8 * head > 0.3


def labelled(spark, name):
    rng = random.Random(6)
    words = [a + b for a in ("an", "er", "th", "on") for b in ("ing", "ea", "le", "st")]
    rows, labels = [], []
    for i in range(400):
        text, y = [rng.choice(words) for _ in range(60)], i % 4 == 0
        if y:
            text = [w + "%%%" for w in text] if name == "quality" else [*text[:30], rng.choice(["moron", "scum"]), *text[30:]]
        rows.append((i, " ".join(text)))
        labels.append((i, int(y) if name == "toxic" else int(not y)))
    labels += [(None, 1), (5, None), (7, 0), (7, 1)]
    return docs(spark, [*rows, (900, None), (901, ""), (None, "x")]), spark.createDataFrame(labels, f"doc_id long, {name} int")


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, name):
    frame, labels = labelled(spark, name)
    held = lm_score.sampled_out("doc_id", 3, 1)
    score = quality.score_quality if name == "quality" else toxicity.score_toxicity
    got = score(frame, labels, ~held)
    known = got.where(held).join(labels.where("doc_id <> 7"), "doc_id").select("predicted", labels[name].alias("y")).collect()
    assert sum(r["predicted"] == r["y"] for r in known) / len(known) > 0.97
    all_rows = got.collect()
    assert len(all_rows) == 403 and all(0 <= r["score"] <= 1 for r in all_rows)
    s = {r["doc_id"]: r["score"] for r in all_rows}
    assert s[900] == s[901]
    assert score(frame, labels.where("false"), ~held).count() == 403
    assert score(frame.where("false"), labels, ~held).count() == 0


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(9)
    examples = [(np.sort(rng.choice(30, 4, replace=False)), rng.integers(1, 4, 4)) for _ in range(90)]
    index = toxicity.Index(rng.random(30) + 0.5, np.arange(90), rng.integers(0, 2, 90).astype(float))
    index.build(examples)
    dense = np.zeros((90, 30))
    for k, (t, n) in enumerate(examples):
        dense[k, t] = index.vector(t, n)
    for k in range(90):
        _, got = index.nearest(*examples[k])
        assert np.allclose(got, np.sort(dense @ dense[k])[::-1][: len(got)]) and len(got) == min(15, (dense @ dense[k] > 1e-12).sum())


def toxicity_terms(word):
    import regex

    runs = regex.findall(r"\p{L}+", word.lower())
    return runs + [f"{x[:k]}-" for x in runs for k in toxicity.STEMS if len(x) > k] or [word]


def test_toxicity_searches_whole_vectors(spark, monkeypatch):
    """Every example is found by all its terms, those of clean texts too, in blocks of lists and common terms."""
    monkeypatch.setattr(toxicity, "COMMON", 5)
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = random.Random(12)
    words = [a + b for a in ("tree", "Stöne", "river", "straße-cloud") for b in "abcdefghijk"] + ["12", "%%", "7"]
    rows = [(i, " ".join(rng.choice(words[i % 3 :: 3]) for _ in range(rng.randint(1, 25)))) for i in range(60)] + [(60, "12 %%"), (61, " \n"), (62, None)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    got = by_id(toxicity.score_toxicity(docs(spark, rows), labels, F.lit(True)))
    counts = {i: collections.Counter(x for w in WORD.findall(t or "") for x in toxicity_terms(w)) for i, t in rows}
    known, df = {x for i in range(40) for x in counts[i]}, collections.Counter(x for c in counts.values() for x in c)
    unit = {}
    for i, c in counts.items():
        w = {x: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[x])) + 1) ** 2 for x, n in c.items() if x in known}
        unit[i] = {x: v / math.sqrt(sum(v * v for v in w.values())) for x, v in w.items()}
    for i, _ in rows:
        cosines = {e: round(sum(v * unit[e].get(x, 0) for x, v in unit[i].items()), 9) for e in range(40)}
        want = sorted(((-c, e) for e, c in cosines.items() if c > 0))[:15]
        assert [e["doc_id"] for e in got[i]["evidence"]] == [e for _, e in want]
        assert np.allclose([e["cosine"] for e in got[i]["evidence"]], [-c for c, _ in want], rtol=0, atol=1e-8)
    assert got[60]["evidence"] and not got[61]["evidence"] and not got[62]["evidence"]


@pytest.mark.parametrize("head", [0, 3, 1 << 17])
def test_lattice_scores(spark, frame, head):
    got = lm_score.score_documents(frame, ~lm_score.sampled_out("doc_id", 7, 2), PIECES, head_words=head).collect()
    counts, ends = collections.Counter(), 0
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in odd():
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(WORD.findall((t or "").translate(lower)))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t in odd():
        w = WORD.findall((t or "").translate(lower))
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1))
        want.append((i or 0, len(w) + 1, sum(x in counts for x in w) + 1, total, round(base, 6)))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    own = lm_score.Lattice(PIECES)
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    rest = min(0.5, discount * kinds / total)
    scores = []
    for i, t in odd():
        w = WORD.findall((t or "").translate(lower))
        lattice = dict(zip(w, own.log10s(w), strict=True))
        score = math.log10(max(ends - discount, 0) / total + rest / total)
        for x in w:
            known = max(counts[x] - discount, 0) / total
            score += math.log10(known + rest * 10 ** lattice[x]) if known else math.log10(rest) + lattice[x]
        scores.append((i or 0, round(score, 5)))
    assert sorted((r["doc_id"] or 0, round(r["score"], 5)) for r in got) == sorted(scores)
    assert lm_score.score_documents(frame.where("false"), F.lit(True), PIECES).count() == 0


def test_scores_do_not_depend_on_the_head(spark, frame):
    score = lambda head: sorted(round(r["score"], 6) for r in lm_score.score_documents(frame, F.lit(True), PIECES, head_words=head).collect())
    assert score(0) == score(1 << 17)


def test_lattice_sums_all_segmentations():
    own = lm_score.Lattice(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {model.id_to_piece(i): i for i in range(259, model.vocab_size())}

    def total(text):
        if not text:
            return 1.0
        out = sum(math.exp(own.logs[ids[text[:k]]]) * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in ids)
        if text[0] not in ids:
            out += math.exp(sum(own.logs[i] for i in own._bytes(ord(text[0])))) * total(text[1:])
        return out

    long = "".join(random.Random(3).choice("abcdefgh☃▁é") for _ in range(3000))
    assert np.allclose(own.log10s([long, long[:70]]), [own._long(long) / math.log(10), own._long(long[:70]) / math.log(10)])
    words = ["the", "thing", "é", "日x", "▁", "a▁b", "☃☃", "erheed"]
    assert np.allclose(own.log10s(words), [math.log10(total("▁" + w)) for w in words])


def test_chat_format(spark):
    kind = "conv_id long, turn long, role string, text string, call_id string, name string, arguments string, result_of string, needs array<string>, call_turn string"
    rows = [
        (1, 0, "a", None, "x", "f", '{"b":1,"a":[1,{"z":2,"y":1.50}]}', None, ["y"], "clash"),
        (1, 1, "a", None, "y", "f", "{bad", None, None, None),
        (1, 2, "tool", "r", None, None, None, "x", None, None),
        (1, 3, "a", None, "p", "f", '{"a":[]}', None, ["q"], None),
        (1, 4, "a", None, "q", "f", '{"a":[],"c":1}', None, ["p"], None),
        (1, 5, "tool", "orphan", None, None, None, "nope", None, None),
        (None, None, None, None, None, None, None, None, None, None),
        (2, 0, "a", "", "x", None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, kind).drop("call_turn")
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.format_chat(frame, {"f": {"a": {"type": "array", "required": True}, "b": {"type": "number"}}}, needs=True).collect()}
    assert len(got) == len(rows)
    assert got[1, 0]["json"] == '{"role":"a","tool_calls":[{"arguments":{"a":[1,{"y":1.5,"z":2}],"b":1},"id":"x","name":"f"}],"turn":0}'
    key = lambda r: (r["order_turn"], r["order_level"], r["order_step"], r["turn"])
    assert [r["turn"] for r in sorted((r for k, r in got.items() if k[0] == 1), key=key)] == [1, 0, 2, 3, 4, 5]
    assert [got[1, t]["valid_arguments"] for t in (0, 1, 3, 4)] == [True, False, True, False]
    assert got[1, 2]["linked"] and got[1, 5]["linked"] is False and got[1, 3]["in_cycle"] and not got[2, 0]["in_cycle"] and got[None, None]["json"] == "{}"
    talk = chat_format.dialogue_turns(spark.createDataFrame([(1, 0, "user", " "), (1, 1, "assistant", None), (1, 2, "user", "hi"), (None, 3, "assistant", "x")], "conv_id long, turn long, role string, text string"))
    out = chat_format.format_chat(talk, chat_format.DIALOGUE_SCHEMAS, needs=True)
    assert sorted((r["turn"], r["order_level"]) for r in out.where("conv_id = 1").collect()) == [(0, 0), (1, 0), (2, 1)]
    assert sorted((r["turn"], r["linked"], r["valid_arguments"]) for r in out.where("conv_id = 1").collect()) == [(0, None, False), (1, True, None), (2, None, True)]
    assert chat_format.format_chat(talk.where("false"), chat_format.DIALOGUE_SCHEMAS).count() == 0


def test_call_order_of_chains_and_graphs(spark):
    """Chains by doubling and graphs by levels, as a plain walk says; the null conversation and the empty one are two."""
    rng = random.Random(6)
    for most in (1, 3):
        rows = []
        for conv in ("a", "", None):
            ids = [f"c{k}" for k in range(40)]
            for k, i in enumerate(ids):
                other = rng.sample(ids[: k + 1] if k % 9 else ids, min(most, k + 1)) if k % 7 else []
                rows.append((conv, rng.randrange(50), "a", i, [x for x in other if x != i] + ["none"]))
        frame = spark.createDataFrame([(c, t, r, "x", i, "f", "{}", None, n) for c, t, r, i, n in rows], "conv_id string, turn long, role string, text string, call_id string, name string, arguments string, result_of string, needs array<string>")
        got = {(r["conv_id"], r["call_id"]): r for r in chat_format.format_chat(frame, {"f": {}}, needs=True).collect()}
        assert len(got) == len(rows)
        need = {(c, i): [(c, x) for x in n if x != "none"] for c, _, _, i, n in rows}
        turn = {(c, i): t for c, t, _, i, _ in rows}

        def place(k, above=()):
            if k in above:
                return None
            below = [place(x, (*above, k)) for x in need[k]]
            return None if None in below else (max([turn[k], *(t for t, _ in below)]), max([0, *(n + 1 for _, n in below)]))

        for k, r in got.items():
            want = place(k)
            assert (r["order_turn"], r["order_level"], r["in_cycle"]) == ((*want, False) if want else (turn[k], 0, True))


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(50, 51), (60, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {50: 50, 51: 50}
