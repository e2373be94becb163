"""The operators against brute-force versions, planted cases and edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from authscope.llm import ann, chat, langid, mixing, packing, quality, secrets, simhash, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", "   \n\t", "!!", "one", "é ß 日本 😀", "x" * 5000, "a b c d " * 3000, "<|endoftext|> and <|im_end|>", "a\x00b\x1fc  d\r\n"]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    """Nulls in any column, odd texts, repeated rows and keys."""
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s1", None, "s2"][i % 3], 1) for i, t in enumerate(ODD_TEXTS)]
    return frame(spark, [*rows, rows[4], rows[4], (4, "other text", None, None, None), (None, "no key", "en", "s1", 3), (None, None, None, None, None)])


#: Names that the operators use inside, names that layouts use, and names that only quoting or case tells apart.
CLASHES = sorted({
    "n_words", "n_lines", "word_chars", "size", "kept", "base_failed", "fp", "position", "n_tokens", "n_bytes", "score", "start", "end", "_source", "u", "root", "_file", "_row_index",
    "_row", "_cuts", "cuts", "_many", "_stay", "hits", "owner", "repository", "stratum", "doc_key", "body", "key", "hash", "tie", "place", "at", "times", "bucket", "part", "before", "copies",
    "taken", "target", "source_size", "source_index", "name", "extra", "rounds", "w0", "component_id", "set_id", "n", "prefix", "row", "digest", "payload", "first", "bytes", "sha1", "count", "lang_pred",
    "_piece", "_group", "sequence_id", "offset", "length", "ids", "a.b", "c0", "c1", "c2", "_metadata", "_stratum", "quality", "_hit", "first_id", "record_type",
    *chat.KNOWN_NAMES,
} - {"text", "turn", "role", "conv_id"})


def crowded(df):
    """df with a column of every clashing name, and one whose name differs from a column's by case alone."""
    more = [F.lit("9").alias(c) for c in CLASHES if c.lower() not in {x.lower() for x in df.columns}]
    return df.select("*", *more, F.lit("8").alias(df.columns[1].upper()))


def clash(spark):
    return crowded(odd(spark))


# token counts and packing


def test_token_counts_match_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd(spark)
    rows = tokens.count_tokens(docs.select("doc_id", "text", F.col("text").alias("t2")), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["t2"] or ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode())


def test_encoders_agree_on_random_texts():
    rng = random.Random(5)
    count, pack = tokens.counter(public_tokenizers.path("byte_bpe_50k.json")), tokens.packer(public_tokenizers.path("word_bpe_49k.json"))
    a, b = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    letters = [*" \n\t\r\x0b\x1c\x85\xa0　aAbé'ßΣςİI.,!12éñ$😀日", "<|endoftext|>", "'s", "'LL", "  ", "İ"]
    plain = [*" \n\t.,!?|#>ab12éÉß÷×ª"]
    for n in range(4000):
        text = "".join(rng.choice(letters if n % 2 else plain) for _ in range(rng.randint(0, 16)))
        assert count([text]) == [len(a.encode(text, add_special_tokens=False).ids)], repr(text)
        assert np.frombuffer(pack([text])[0], "<u4").tolist() == b.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Some words,  and\n\nmore  of them " * 40 + "y" * 300
    assert tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False).texts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("capacity, block", [(64, 16), (2048, 512)])
def test_packing_keeps_every_id_once(spark, capacity, block):
    rng = random.Random(1)
    some = [(100 + i, " ".join(rng.choice("alpha beta gamma delta straße 12 !?".split()) for _ in range(rng.randint(1, 300))), "en", "s", 0) for i in range(60)]
    docs = frame(spark, some).unionByName(odd(spark))
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=capacity, block=block, group=64, with_ids=True).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in docs.select("doc_id", "text").collect())
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["start"], tuple(ids.tolist()), r["doc_tokens"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for (doc, ids), n in expected.items():
        own = Counter((s, p) for s, p, total in parts[doc] if total == len(ids))
        for start, length in packing.cuts(len(ids), capacity, block):
            assert own[start, ids[start : start + length]] >= n
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in expected.items())
    if capacity == 64:
        assert len(sequences) * capacity <= 1.05 * sum(r["length"] for r in rows) + capacity


def test_differencing_is_near_equal_and_raises_the_window_count():
    rng = random.Random(3)
    sizes = [rng.randint(1, 500) for _ in range(300)]
    found = packing.differencing(sizes, 20)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(300))
    assert max(sums) - min(sums) <= 0.01 * max(sums)
    assert len(packing.windows([1025] * 5, 2048)) == 5  # two don't fit: from 3 windows up to 5
    assert packing.windows([]) == []


@pytest.mark.parametrize("packed", [False, True])
def test_long_text_between_short_ones_with_a_tiny_memory(monkeypatch, packed):
    path = public_tokenizers.path("word_bpe_49k.json" if packed else "byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 60)
    encoder = tokens.Encoder(path, packed)
    one, two, long = "one two three", "one two three four five six", "far longer text of many words " * 6
    library = Tokenizer.from_file(path)
    for batch in ([one], [two, long, two, None, one], [one], [two, "  \n ", one, long, two]):
        ids = [library.encode(t or "", add_special_tokens=False).ids for t in batch]
        assert encoder.texts(batch) == [np.array(x, "<u4").tobytes() if packed else len(x) for x in ids]


def test_each_task_begins_without_remembered_pieces():
    path = public_tokenizers.path("word_bpe_49k.json")
    first, second = tokens.packer(path), tokens.packer(path)
    assert first(["one two", "two three"]) == second(["one two", "two three"])
    assert first.__self__.known and first.__self__.known is not second.__self__.known
    assert first.__self__.tokenizer is second.__self__.tokenizer  # loaded once a worker
    assert not tokens.packer(path).__self__.known


@pytest.mark.parametrize("packed", [False, True])
def test_random_batches_of_plain_and_odd_texts_match_the_library(monkeypatch, packed):
    path = public_tokenizers.path("word_bpe_49k.json" if packed else "byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    monkeypatch.setattr(tokens, "REMEMBERED_CHARS", 4)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    rng, library, encoder = random.Random(11), Tokenizer.from_file(path), tokens.Encoder(path, packed)
    some = [*" \n\t", "one", "Two", "ÀÉÿß", "12", "3", "!?", ".", "[a]", "`{~}", "verylongword", "1,2,"]
    for n in range(300):
        batch = ["".join(rng.choice(some if n % 3 else [*some, "'s", "<", "日", "\xa0"]) for _ in range(rng.choice((0, 1, 5, 20, 60)))) for _ in range(rng.randint(0, 4))]
        ids = [library.encode(t, add_special_tokens=False).ids for t in batch]
        assert encoder.texts(batch) == [np.array(x, "<u4").tobytes() if packed else len(x) for x in ids], batch


def test_packing_looks_up_each_piece_once_a_batch():
    asked = Counter()

    class Known(dict):
        def get(self, key):
            asked[key] += 1
            return super().get(key)

        def __getitem__(self, key):
            asked[key] += 1
            return super().__getitem__(key)

    pack = tokens.packer(public_tokenizers.path("word_bpe_49k.json"))
    pack.__self__.known = Known()
    assert len(set(pack(["One two, two 1"] * 50))) == 1
    assert {"one", "two", ",", "1"} <= set(asked) and max(asked.values()) == 1


def test_digits_without_white_space_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 40)
    path, sizes = public_tokenizers.path("word_bpe_49k.json"), []
    encoder, text = tokens.Encoder(path, True), "1,23," * 100
    values = encoder._values
    monkeypatch.setattr(encoder, "_values", lambda texts: sizes.append(max(map(len, texts))) or values(texts))
    assert np.frombuffer(encoder.texts([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert max(sizes) <= 45


# near duplicates


def slow_fingerprint(text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps: dict):
    keys, root = list(fps), {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def near_copies(rng, n=60):
    rows = []
    for i in range(n):
        words = [rng.choice(["tree", "Sun", "rain", "é", "road", "old", "two"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(40, 400))]
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            other = list(words)
            other[rng.randrange(len(other))] = "changed"
            rows.append("  ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    return rows


def test_simhash_components_match_brute_force(spark):
    texts = [*near_copies(random.Random(2)), *ODD_TEXTS, "", "one"]
    rows = simhash.near_duplicates(frame(spark, [(7 * i % 997, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    fps = {7 * i % 997: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in rows} == fps
    assert {r["doc_id"]: r["component_id"] for r in rows} == slow_components(fps)


def test_links_are_complete_at_the_segment_borders(spark):
    rng, base = random.Random(4), 0x0123456789ABCDEF
    values = {base}
    for k in range(1, 7):
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            values.add(x)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long"), 4).collect()]
    expected = {frozenset((a, b)) for a in values for b in values if a != b and (a ^ b).bit_count() <= 4}
    assert len(found) == len(expected) and {frozenset(x) for x in found} == expected


def test_long_chains_settle(spark):
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {tuple(r) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(1, 201)}


def test_dedup_keeps_one_of_each_group_and_every_other_row(spark):
    rows = [(5, "a b c d e f", "en", "s", 1), (3, "A B C D E F", "fr", "s", 1), (9, "quite another text it is", "en", None, 2), (9, "quite another text it is", "en", None, 2), (None, "nameless", None, None, None), (11, None, None, None, 0), (12, "", None, None, 0)]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 9), (False, 11), (True, 0)]
    assert simhash.keep_one(clash(spark)).columns == clash(spark).columns


def test_near_copies_are_grouped_by_jaccard(spark):
    rng, rows, expected = random.Random(21), [], {}
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    for g in range(120):
        base = [word() for _ in range(rng.randint(150, 500))]
        for _ in range(rng.randint(1, 4)):
            other = list(base)
            for at in rng.sample(range(len(other)), rng.choice([0, 1, 2, 3])):
                other[at] = word()
            rows.append((len(rows), " ".join(other), "en", "s", 0))
            expected.setdefault(g, []).append(len(rows) - 1)
    shingles = [frozenset(tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)) for r in rows]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    near = [(a, b) for ids in expected.values() for a in ids for b in ids if a < b and len(shingles[a] & shingles[b]) >= 0.85 * len(shingles[a] | shingles[b])]
    assert sum(found[a] == found[b] for a, b in near) >= 0.95 * len(near) > 50
    group = {d: g for g, ids in expected.items() for d in ids}
    assert all(group[d] == group[c] for d, c in found.items())  # strangers never meet


def jaccard(a, b):
    a, b = (frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_are_exactly_those_with_a_jaccard_of_four_fifths(spark):
    rng, rows = random.Random(22), []
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    for n in range(150):
        base = [word() for _ in range(rng.randint(60, 300))]
        other = list(base)
        at = rng.randrange(len(base))  # one run of other words, for similarities of about 0.7 to 0.9
        length = round(len(base) * rng.uniform(0.05, 0.17))
        other[at : at + length] = [word() for _ in other[at : at + length]]
        rows += [(2 * n, " ".join(base), "en", "s", 0), (2 * n + 1, " ".join(other), "en", "s", 0)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    similar = [jaccard(rows[2 * n][1], rows[2 * n + 1][1]) for n in range(150)]
    assert sum(0.8 <= s < 0.85 for s in similar) > 15 and sum(0.75 <= s < 0.8 for s in similar) > 15
    assert all(found[2 * n] == 2 * n for n in range(150))
    assert [found[2 * n + 1] == 2 * n for n in range(150)] == [s >= 0.8 for s in similar]


def test_dedup_decides_by_row_where_a_key_is_shared(spark):
    texts = [f"{w} is a clean text that no other one repeats {w} at all {w}" for w in "alpha beta gamma delta".split()]
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(7, t) for t in texts] + [(5, near), (7, near.upper())]  # the last is a copy of a smaller id
    kept = simhash.keep_one(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, near), *[(7, t) for t in texts]])


# quality


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures_match_brute_force():
    rng = random.Random(6)
    for t in [*ODD_TEXTS, *(" ".join(rng.choice("abcd") + rng.choice(["", "\n", "#"]) for _ in range(rng.randint(0, 40))) for _ in range(400))]:
        assert quality.measures(t)[:5] == slow_measures(t), repr(t)


def test_binomial_tail_is_exact():
    from math import comb

    for n, k, p in ((5, 0, 0.1), (40, 3, 0.02), (40, 39, 0.5), (200, 7, 0.05), (200, 20, 0.05), (7, 7, 0.3)):
        q = Fraction(p)
        exact = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_are_certified_per_stratum(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(6000):
        bad, lang = i % 5 == 0, ("en", "fr")[i % 2]
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        rows.append((i, " ".join(w + "###" if bad else w for w in words), lang if i > 5 else None, "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    found = quality.assess(frame(spark, rows), frame(spark, [*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) for r in found if r["lang"])
    assert all(r["kept"] for r in found if r["lang"] is None)  # six labels certify nothing


def test_quality_edge_rows(spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    found = quality.assess(clash(spark), none).collect()
    assert len(found) == odd(spark).count()
    assert all(r["base_failed"] and not r["kept"] for r in found)
    assert quality.keep_good(clash(spark), none).columns == clash(spark).columns
    assert quality.assess(frame(spark, []), none).count() == 0
    good = frame(spark, [(1, " ".join(map(str, range(80))), None, None, 0)] * 2)
    assert quality.keep_good(good, none).count() == 2


# secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(9)
    parts = ["token=", "secret: ", "API_KEY = '", "apikey:\"", "PassWord=", "passwd ", "AKIA", "AKIAABCDEFGHIJ12345", "0123456789abcdef", "é😀", " ", "\n", "abcdefghijkl", "A1b2C3d4E5f6G7", "=", "x", "AKIAZ", "deadbeef"]
    texts = [*ODD_TEXTS, "token=secret: abcdefghijklmnop", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(500))]
    docs = frame(spark, [(i, t, "en", f"s{i % 7}", 0) for i, t in enumerate(texts)])
    for r in secrets.digest(secrets.scan(docs)).collect():
        base = slow_secrets(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)], repr(texts[r["doc_id"]])
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in ("assign", "access", "hex")] == [s for s in written.split(",") if s]


def test_widely_copied_values_are_examples(spark):
    shared, own = "token = 4f9a1c7e2b8d6035e1f4", "token = 9c2e7a41d0b85f63a7e2"
    docs = frame(spark, [(i, f"see {shared} here", "en", f"s{i}", 0) for i in range(8)] + [(20 + i, f"my {own} is {own}", "en", "s0", 0) for i in range(30)])
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(docs)).collect()}
    assert "example:" in spans[0] and "live:" not in spans[0]
    assert spans[20].count("live:") == 2 and "example:" not in spans[20]
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert texts[0] == f"see {shared} here" and texts[20] == "my token = [SECRET] is token = [SECRET]"


def test_secret_edge_rows(spark):
    assert secrets.scan(clash(spark)).count() == odd(spark).count()
    same = secrets.redact(clash(spark))
    assert same.columns == clash(spark).columns and same.count() == odd(spark).count()
    assert secrets.scan(frame(spark, [])).count() == 0


# mixing


def test_targets_fill_up_to_the_ceiling(spark):
    assert slow_fill([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert slow_fill([0, 10], [5, 2]) == pytest.approx([0, 15])
    rng = random.Random(21)
    for n in (1, 2, 3, 7, 40):
        for sizes in ([rng.choice([0, 1, 5, 100, 10_000]) for _ in range(n)], [rng.randint(1, 100) for _ in range(n)]):
            weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(n)]
            table = spark.createDataFrame(list(zip(range(n), sizes, weights, strict=True)), "source_index long, source_size long, weight double")
            got = [r["target"] for r in mixing.fill(table).orderBy("source_index").collect()]
            assert got == pytest.approx(slow_fill(sizes, weights))


def slow_fill(sizes, weights, share=1.5, ceiling=2.0):
    """Shares by weight; what is above a ceiling goes to the others, again and again."""
    left, targets, waiting = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while waiting:
        total = sum(weights[i] for i in waiting)
        full = {i for i in waiting if left * weights[i] / total >= ceiling * sizes[i]}
        for i in full or waiting:
            targets[i] = float(ceiling * sizes[i]) if full else left * weights[i] / total
        left -= sum(targets[i] for i in full)
        waiting = waiting - full if full else set()
    return targets


def test_mix_meets_targets(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(0, 50), "en", rng.choice(["a", "b", "b", "b", "ß", "Z", None]), 0) for i in range(9000)]
    planned = mixing.plan(frame(spark, rows)).collect()
    sizes, taken, whole, target = Counter(), Counter(), Counter(), {}
    for r in planned:
        s = rows[r["doc_id"]][3]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert (r["position"] is None) == (r["copies"] == 0) and 0 <= (r["position"] or 0) <= 1
    names = [*sorted(s for s in sizes if s is not None), None]
    expected = slow_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for r in mixing.mix(frame(spark, rows)).collect():
        whole[r["source"]] += len(r["text"].split())
    for s, t in zip(names, expected, strict=True):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1 and abs(whole[s] - t) <= 26
    again = mixing.plan(frame(spark, rows[::-1]).repartition(3)).collect()
    assert {r["doc_id"]: (r["taken"], r["position"]) for r in again} == {r["doc_id"]: (r["taken"], r["position"]) for r in planned}


def test_time_inverts_the_integrated_schedule(spark):
    for schedule in mixing.SCHEDULES:
        rows = [(i / 200, *map(float, schedule)) for i in range(201)]
        for r in spark.createDataFrame(rows, "y double, w0 double, w1 double, w2 double").select("y", mixing._time(F.col("y")).alias("t")).collect():
            x = np.linspace(0, r["t"], 2001)
            y = np.linspace(0, 1, 2001)
            area = lambda at: np.trapezoid(np.interp(at, mixing.KNOTS, schedule), at)  # noqa: B023, E731
            assert area(x) / area(y) == pytest.approx(r["y"], abs=1e-4)


def test_mix_emits_copies_in_order_of_time(spark):
    docs = frame(spark, [(i, f"word {i} and more", "en", "abc"[i % 3], 0) for i in range(9000)])
    planned = {r["doc_id"]: (r["copies"], r["position"]) for r in mixing.plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    met = [r["doc_id"] for r in out.collect()]
    assert sum(abs(n - planned[d][0]) for d, n in Counter(met).items()) <= 3  # but for the cut document of each source
    first = {d: i for i, d in reversed(list(enumerate(met)))}
    order = sorted(first, key=first.get)
    times = np.array([planned[d][1] for d in order if planned[d][1] is not None])
    assert (times == np.sort(times)).all()  # exactly as planned
    assert mixing.mix(clash(spark)).columns == clash(spark).columns
    assert mixing.mix(frame(spark, [])).count() == 0
    same = frame(spark, [(1, "a b", "en", "s", 0)] * 100 + [(2, "c", "en", "t", 0)] * 100)
    taken = Counter(r["source"] for r in mixing.mix(same).collect())
    targets = slow_fill([200, 100], [5, 2])
    assert abs(2 * taken["s"] - targets[0]) <= 2 and abs(taken["t"] - targets[1]) <= 1


# archive


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(4, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (None, "u", "z"), (5, "u", "only"), (7, "u", "WARC/1.1\r\n\r\n")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path)
    records = warc.read_records(spark, path)
    found = {r["page_id"]: r for r in warc.describe(records).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in found.items()} == {2: ("response", None), 4: ("revisit", 2), 8: ("response", None), 9: ("revisit", 8), None: ("response", None), 5: ("response", None), 7: ("response", None)}
    import base64

    assert found[4]["payload_digest"] == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert found[4]["payload_bytes"] == 9
    assert spark.read.parquet(f"{path}/payloads").count() == 5  # each payload once
    for r in records.collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[length:] == b"\r\n\r\n"
        if r["page_id"] in (2, 5):
            assert rest[:length].endswith({2: "<p>é</p>".encode(), 5: b"only"}[r["page_id"]])


def test_archive_notices_wrong_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    spark.createDataFrame([("00", bytearray(b"x"))], "digest string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="wrong bytes"):
        warc.read_payloads(spark, path).collect()


# chat


def test_escape_is_reversible(spark):
    rng = random.Random(11)
    texts = [*filter(None, ODD_TEXTS), *("".join(rng.choice(["<", "|", "\\", ">", "<|", "im_end", "a", "\n", "$1"]) for _ in range(rng.randint(0, 9))) for _ in range(500))]
    rows = [(i, [(t, t) for t in texts[i : i + 3]]) for i in range(len(texts))]
    made = chat.render(spark.createDataFrame(rows, f"conv_id long, turns {chat.TURNS}"))
    for r in chat.read_back(made).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == rows[r["conv_id"]][1]
        assert r["formatted"].count(chat.START) == r["formatted"].count("<|") / 2 == len(r["turns"])


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "q", "completion": "a"}',
        '{"instruction": "q", "input": "", "output": "a", "meta": {"x": 1}}',
        '{"instruction": "q", "input": "more", "output": "a"}',
        '{"question": "q", "answer": "a"}',
        '{"unknown": 1}',
        "no json",
        None,
    ]
    found = [r["turns"] for r in chat.canonical_json(spark.createDataFrame(list(enumerate(records)), "k long, j string"), "k", "j").orderBy("k").collect()]
    two = [("user", "q"), ("assistant", "a")]
    assert [t and [tuple(x) for x in t] for t in found] == [two, two, two, two, [two[0], ("user", "more"), two[1]], two, None, None, None]
    table = spark.createDataFrame([(1, [("q", "user", 0), (None, None, 1)])], "k long, messages array<struct<content:string,role:string,extra:int>>")
    assert [tuple(x) for x in chat.canonical(table, "k").first()["turns"]] == [("user", "q"), ("", "")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.range(1))


def test_loss_spans_point_at_trained_text(spark):
    rows = [(1, 0, "user", "hé <|x"), (1, 1, "assistant", "a <|im_end|> 😀"), (1, 2, "assistant", None), (None, 0, "assistant", "z"), (1, 1, "assistant", "a <|im_end|> 😀")]
    made = chat.render(chat.canonical(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    text = {r["conv_id"]: r["formatted"] for r in made.collect()}
    found = sorted((str(r["conv_id"]), r["start"], text[r["conv_id"]][r["start"] : r["end"]]) for r in chat.loss_spans(made).collect())
    assert [x[2] for x in found] == ["a <\\|im_end|> 😀", "a <\\|im_end|> 😀", "", "z"]
    assert chat.render(chat.canonical(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# nearest neighbours


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((12, 24)) * 2
    x = centres[rng.integers(12, size=3000)] + rng.standard_normal((3000, 24))
    x[500:1500] = x[500]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0]), (5004, [None] * 24), (None, x[0].tolist()), (5005, [float("inf")] + [0.0] * 23)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    p = ann.Forest(trees=6, share=0.9, block_rows=256, query_rows=7, fit_rows=1500)
    found = defaultdict(list)
    for r in ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), p=p).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["score"], r["vec_id"]))
    assert sorted(found) == list(range(0, 3000, 100))
    hits = total = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        true = sorted((s, i) for i, s in enumerate(d) if i != q)[:10]
        assert len(got) == 10 and got == sorted(got) and all(s == pytest.approx(d[i], abs=1e-9) and i != q for s, i in got)
        hits += len({i for _, i in true} & {i for _, i in got})
        total += 10
    assert hits / total >= 0.9


def test_nearest_in_small_and_empty_tables(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(few, few.filter("vec_id = 1")).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 2)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [lambda i: 2, lambda i: 1000 if i == 7 else 1])
def test_nearest_counts_repeated_ids_once(spark, copies):
    x = np.random.default_rng(14).standard_normal((400, 8))
    x[7] = x[0]  # next to the query
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) for _ in range(copies(i))], "vec_id long, embedding array<double>")
    p = ann.Forest(trees=2, share=9.0, block_rows=4096)
    got = [r["vec_id"] for r in ann.nearest(vectors, vectors.filter("vec_id = 0").limit(1), p=p).orderBy("rank").collect()]
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    assert got == [i for _, i in sorted((s, i) for i, s in enumerate(d) if i)][:10]


# language


def test_posteriors_match_one_by_one():
    rng = np.random.default_rng(13)
    scores, starts, a = rng.standard_normal((150, 3)), np.array([0, 70, 71]), rng.standard_normal((3, 3))
    found = langid.posteriors(scores, starts, a)
    for first, end in ((0, 70), (70, 71), (71, 150)):
        ahead, now = [], np.full(3, 1 / 3)
        for k in range(first, end):
            now = (now @ np.exp(a)) * np.exp(scores[k])
            now /= now.sum()
            ahead.append(now)
        z = np.ones(3)
        for k in reversed(range(first, end)):
            g = ahead[k - first] * z
            assert np.allclose(g / g.sum(), found[k])
            z = np.exp(a) @ (np.exp(scores[k]) * z)
            z /= z.sum()


def languages(rng, n):
    own = {"en": ["the", "and", "ing", "th", "er", "wh"], "de": ["sch", "und", "ich", "ei", "keit", "ü"], "fr": ["eau", "è", "oi", "que", "ai", "ç"]}
    text = lambda lang, m: " ".join("".join(rng.choice(own[lang]) for _ in range(rng.randint(1, 3))) for _ in range(m))
    return [(text(lang, rng.randint(5, 60)), lang) for lang in own for _ in range(n)], text


def test_crf_labels_code_switched_words():
    rows, text = languages(random.Random(14), 60)
    model = langid.fit(rows)
    held, _ = languages(random.Random(15), 40)
    assert np.mean([model.identify([t])[0][0] == lang for t, lang in held]) >= 0.97
    mixed = langid.words(text("en", 40)) + langid.words(text("fr", 40))
    marks = [model.labels[i] for i in model.label_words([mixed])[0].argmax(axis=1)]
    assert np.mean([m == ("en" if k < 40 else "fr") for k, m in enumerate(marks)]) >= 0.95
    assert model.identify([None, "", "12 ½ !?"]) == [("und", 0.0)] * 3


def test_language_edge_rows(spark):
    rows, _ = languages(random.Random(16), 30)
    train = frame(spark, [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)])
    found = langid.identify(clash(spark), train).collect()
    assert len(found) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found} <= {"en", "de", "fr", "und"}
    assert {r["lang_pred"] for r in langid.identify(odd(spark), frame(spark, [])).collect()} == {"und"}


# all operators


def test_archive_of_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>same</p>")] * 3 + [(1, "v", "other"), (None, "u", "<p>same</p>"), (2, None, None), (3, "u", "\r\n\r\n" * 3), (4, "u", "ü" * 100_000)], "page_id long, url string, html string")
    found = [tuple(r) for r in warc.describe(warc.read_records(spark, warc.archive(crowded(pages)))).collect()]
    kinds = Counter((r[0], r[3], r[4]) for r in found)
    assert kinds == {(1, "response", None): 2, (1, "revisit", 1): 2, (None, "response", None): 1, (2, "response", None): 1, (3, "response", None): 1, (4, "response", None): 1}
    sizes = {r[0]: r[1] for r in found}
    assert sizes[2] == 0 and sizes[3] == 12 and sizes[4] == 200_000
    records = warc.parse(warc.read_records(spark, warc.archive(pages)))
    ids = [r["record_id"] for r in records.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == 8
    assert {bytes(r["payload"]) for r in records.filter("record_type = 'response'").collect()} == {b"<p>same</p>", b"other", b"", b"\r\n" * 6, ("ü" * 100_000).encode()}
    assert {r["uri"] for r in records.collect()} == {"u", "v", "urn:none"}
    assert warc.describe(warc.read_records(spark, warc.archive(pages.limit(0)))).count() == 0
    small = warc.describe(warc.read_records(spark, warc.archive(pages, least=12))).collect()
    assert {r["record_type"] for r in small if r["payload_bytes"] < 12} == {"response"}


def test_broken_records_stop_the_job(spark):
    header = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab\r\n\r\n"
    frame_of = lambda n: spark.createDataFrame([(1, bytearray(header % n))], "page_id long, record binary")
    assert bytes(warc.parse(frame_of(21)).first()["payload"]) == b"ab"
    with pytest.raises(Exception, match="broken record"):
        warc.parse(frame_of(20)).collect()


def test_clashing_names_in_every_operator(spark):
    docs, n = clash(spark), odd(spark).count()
    labels = crowded(frame(spark, [(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert langid.identify(docs, docs).columns == ["doc_id", "lang_pred", "score"]
    assert quality.assess(docs, labels).count() == n
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert secrets.digest(secrets.scan(docs)).count() == n
    assert secrets.digest(secrets.scan(docs, owner=F.col("source"), repository=F.lit("r"))).count() == n
    same = secrets.redact(docs)
    assert same.columns == docs.columns and same.count() == n
    assert secrets.redact(docs, owner=F.col("n_chars").cast("string")).count() == n
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert counted.columns.count("n_tokens") == 1 and counted.count() == n
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert mixing.plan(docs).count() == n
    assert mixing.mix(docs).columns == docs.columns
    assert simhash.near_duplicates(docs).count() == n
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and one.count() <= n
    talk = crowded(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn int, role string, text string"))
    assert chat.digest(chat.read_back(chat.render(chat.canonical(talk)))).filter("conv_id = 1").first()["n_turns"] == 2
    assert chat.canonical(talk).count() == 3  # rows without a key are conversations of their own
    vectors = crowded(spark.createDataFrame([(i, "x", [float(i), 1.0]) for i in range(30)], "vec_id long, label string, embedding array<double>"))
    assert ann.nearest(vectors, vectors.filter("vec_id = 0")).count() == 10


def test_stored_files_with_odd_columns(spark, tmp_path):
    """Scans whose own columns are called like the engine's hidden ones still get row identities."""
    table = frame(spark, [(1, "a b", "en", "s", 0)] * 3).withColumn("_metadata", F.lit(1)).withColumn("_file", F.lit(2))
    table.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert mixing.plan(back).count() == 3 and simhash.keep_one(back).columns == back.columns
    from authscope.llm.common import ROW_ID, with_row_id

    twice = spark.read.parquet(str(tmp_path / "t")).drop("_metadata").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))
    assert with_row_id(twice).select(*ROW_ID).distinct().count() == 6  # rows that an expression repeats aren't one


def test_empty_tables_everywhere(spark):
    docs, none = frame(spark, []), frame(spark, [], "doc_id long, quality int, toxic int")
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert mixing.plan(docs).count() == 0 and quality.keep_good(docs, none).count() == 0
    assert secrets.redact(docs).count() == 0 and langid.identify(docs, docs).count() == 0
    assert simhash.keep_one(docs).count() == 0 and simhash.near_duplicates(docs).count() == 0


def test_one_key_on_half_the_rows(spark):
    rng = random.Random(31)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(1, 30)))
    rows = [(7 if i % 2 else i, text(), ("en", "de")[i % 3 == 0], f"s{i % 5}", 0) for i in range(3000)]
    assert len(langid.training_rows(frame(spark, rows), "text", "lang", "doc_id", langid.Training(rows_per_language=50))) == 100
    same = [(7, "same text", "en", "s1", 0)] * 20_000 + [(i, text(), "en", "s2", 0) for i in range(500)]
    planned = mixing.plan(frame(spark, same)).collect()
    taken, targets = Counter(), {}
    for r in planned:
        taken[r["source_size"]] += r["taken"]
        targets[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items()) and len(planned) == 20_500


def test_many_sources(spark):
    rows = [(i, "w " * (i % 9), "en", f"source {i % 20_000:05d}", 0) for i in range(40_000)]
    planned = mixing.plan(frame(spark, rows)).groupBy("source_size").agg(F.sum("taken").alias("t"), F.max("target").alias("m")).collect()
    assert len(planned) > 1
    own = mixing.plan(frame(spark, rows[:50]), schedules={"source 00001": (0.0, 0.0, 1.0)}).filter("doc_id = 1").first()
    assert own["position"] is None or own["position"] >= 0.5


def test_quality_finds_more_in_small_strata(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(700):
        bad, lang = i % 4 == 0, ("en", "fr")[i < 350]
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        rows.append((i, " ".join(w + "#" * bad for w in words), lang, "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    found = quality.assess(frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in found)


def test_risk_holds_where_rules_do_not_help():
    """Good and bad documents alike: over many draws the certified set rejects at most the risk of good ones."""
    import pandas as pd

    rng, p, failed = np.random.default_rng(5), quality.Risk(price=0.0), 0
    for _ in range(200):
        levels = rng.integers(0, 11, size=(600, len(quality.RULES)))
        levels[rng.random(levels.shape) < 0.9] = 0
        cells = pd.DataFrame({c: levels[:, i] for i, c in enumerate(quality.LEVELS)} | {"good": rng.random(600) < 0.5, "proposes": rng.random(600) < 0.5, "n": 1})
        state = quality.choose(cells, 1, p)
        if state:
            fresh = rng.integers(0, 11, size=(20_000, len(quality.RULES)))
            fresh[rng.random(fresh.shape) < 0.9] = 0
            failed += (fresh >= np.array(state)).any(axis=1).mean() > p.risk
    assert failed <= 0.1 * 200  # delta is 0.05


def test_values_are_judged_by_more_than_their_digits(spark):
    texts = {"password = correcthorsebattery": "live", "token = 9c2e0000d0b85f63a7e2b1": "live", "token = xxxxxxxxxxxxxxxx1234567": "example", "secret = my_example_value_123": "example", "deadbeefdeadbeef": "example"}
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(docs)).collect()}
    assert [("live" if "live:" in spans[i] else "example") for i in range(len(texts))] == list(texts.values())


def test_digits_behind_letters_are_safe_places():
    from authscope.llm.common import safe_blocks

    text = "ab12" * 5000
    parts = list(safe_blocks(text, 100))
    assert "".join(parts) == text and max(map(len, parts)) <= 110
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        encode = lambda t: library.encode(t, add_special_tokens=False).ids  # noqa: B023, E731
        assert sum((encode(x) for x in parts), []) == encode(text)


def test_an_unfolded_index_is_never_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    try:
        texts = spark.range(2000).selectExpr("id as set_id", "explode(array(id % 7, id, id % 900)) as shingle")
        for made in (simhash.links(spark.range(2000).selectExpr("id * 7919 as fp")), simhash.repeated(texts)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(0,), (15,), (31,)], "fp long")).collect()}
    assert found == {(0, 15), (15, 31)}
    assert simhash.repeated(texts).filter("set_id < 7").count() == sum(1 for i in range(7) for _ in range(3))
