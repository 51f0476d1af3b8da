"""Each operator against a plain version of its definition, on rows with every edge case."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from concord.llm import language, line_dedup, media, mixing, packing, simhash, token_counts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def plain_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components(items, near):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def test_simhash_matches_brute_force(docs, rows):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {k: min((r[0] for r, q in zip(rows, roots, strict=True) if q == k and r[0] is not None), default=None) for k in set(roots)}
    assert got == Counter((r[0], f"{f:016x}", low[k]) for r, f, k in zip(rows, prints, roots, strict=True))


@pytest.mark.parametrize(("group", "hot"), [(65_536, 200_000), (65_536, 9), (4, 200_000), (1, 3)])
def test_trie_join_finds_every_link(spark, monkeypatch, group, hot):
    """Whole groups, groups dealt by pairs of parts, and longer keys of more blocks give the same components."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SETTLE", 50)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 6)]
    flips += [int(base[0]) ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (120, 2))]
    values = sorted(set(flips))
    nodes = spark.createDataFrame([(k, bytearray(int(v).to_bytes(8, "little"))) for k, v in enumerate(values)], "node long, sig binary")
    edges = [(r.src, r.dst) for r in simhash.links(nodes, 64, 1, 3).collect()]
    want = components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    label = simhash.spanning(len(values), np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    groups = defaultdict(set)
    for k, w in enumerate(want):
        groups[w].add(int(label[k]))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label.tolist()))
    assert all((values[a] ^ values[b]).bit_count() <= 64 for a, b in edges)


def test_a_large_group_of_equal_tables_is_joined_without_all_pairs():
    """Rows that are all linked settle: node pairs below them are passed over."""
    n = 30_000
    seen = []
    near = lambda a, b: seen.append(len(a)) or np.ones(len(a), bool)
    rows, label = simhash.join_groups(np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.full(n, 5, np.uint64), 31, 3, near)
    assert len(rows) == n - 1 and sum(seen) < n * n / 50


def test_dealt_rows_for_each_text_stay_the_same(spark):
    """Two million signatures are dealt as often as twenty thousand; far more take more blocks, step by step."""
    for n in (20_000, 2_000_000):
        sig = F.concat(F.unhex(F.lpad(F.hex(F.xxhash64("id")), 16, "0")), F.unhex(F.lpad(F.hex(F.xxhash64("id", F.lit(1))), 16, "0")))
        nodes = spark.range(n).select(F.col("id").alias("node"), sig.alias("sig"))
        dealt = simhash.deal(nodes, simhash.block_sizes(n, 32, 3), 32, 2, 3)
        largest = dealt.groupBy("key").count().agg(F.sum("count"), F.max("count")).first()
        assert largest[0] == 8 * n and largest[1] <= simhash.GROUP
    blocks = [len(simhash.block_sizes(n, 32, 3)) for n in (10**5, 15 * 10**6, 10**8, 10**9)]
    assert blocks == [4, 4, 5, 6]


def test_deduplicate_keeps_one_of_each_group(docs, rows):
    kept = simhash.deduplicate(docs).collect()
    assert Counter(r.text for r in kept if r.doc_id == 206)["Zwei  Räume <|endoftext|> don't we'll go é"] == 1
    assert sum(r.doc_id is None for r in kept) == 1
    assert [r.doc_id for r in kept if not (r.text or "").split()] == [200]
    assert len(kept[0]) == len(rows[0])


@pytest.mark.parametrize("part", [512, 8])
def test_deduplicate_links_by_exact_jaccard(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(8)
    texts = []
    for k in range(160):
        own = [f"w{x}" for x in rng.integers(0, 5000, 60 + k)]
        copy = list(own)
        for at in rng.choice(len(own), 1 + k % 8, replace=False):
            copy[at] = f"x{k}y{at}"
        texts += [" ".join(own), " ".join(copy)]
    for _ in range(40):  # one large group
        copy = texts[300].split()
        copy[int(rng.integers(0, len(copy)))] = f"z{rng.integers(0, 5000)}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    roots = components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    low = {root: min(k for k, r in enumerate(roots) if r == root) for root in roots}
    got = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == set(low.values())


def test_media_round_trip(docs, rows):
    got = {r.doc_id: r for r in media.digests(media.store_texts(docs)).collect() if r.doc_id is not None}
    for doc_id, text in {r[0]: r[1] for r in rows if r[0] not in (None, 3)}.items():
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(media.COMPRESSIONS)), st.sampled_from([1, 2]), st.sampled_from([None, (16, 32)]), st.sampled_from("<>"), st.binary(max_size=5000), st.integers(1, 90))
def test_tiff_pages_round_trip(compression, predictor, tile, order, raw, width):
    raw += b"\0" * (-len(raw) % width or (0 if raw else width))
    pages = [np.frombuffer(raw, np.uint8).reshape(-1, width), np.full((3, 7), 9, np.uint8)]
    data = media.write_tiff(pages, compression, predictor, tile, 16, order)
    back = [media.decode_page(data, tags) for tags in media.directories(data)]
    assert all((a == b).all() for a, b in zip(pages, back, strict=True))


def test_blocks_as_other_writers_make_them():
    """Examples that the formats' descriptions give, and damage."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert media.unlzw(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and media.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media.unpackbits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    bad = "".join(f"{c:09b}" for c in (256, 7, 400, 257))
    with pytest.raises(ValueError, match="LZW code 400"):
        media.unlzw(int(bad.ljust(40, "0"), 2).to_bytes(5, "big"), 9)


def test_planes_are_read():
    """A page of three samples, each in a plane of its own, strip by strip."""
    page = np.random.default_rng(1).integers(0, 256, (5, 4, 3)).astype(np.uint8)
    strips = [page[y : y + 2, :, p].tobytes() for p in range(3) for y in (0, 2, 4)]
    data, offsets = bytearray(8), []
    for s in strips:
        offsets.append(len(data))
        data += s
    tags = {media.WIDTH: (4,), media.HEIGHT: (5,), media.BITS: (8, 8, 8), media.COMPRESSION: (1,), media.SAMPLES: (3,), media.STRIP_ROWS: (2,), media.PLANES: (2,), media.STRIPS: tuple(offsets), media.STRIP_BYTES: tuple(map(len, strips))}
    assert (media.decode_page(bytes(data), tags) == page.reshape(5, 12)).all()


def test_page_rows_reports_damage(spark):
    good = media.write_tiff([np.zeros((2, 3), np.uint8)] * 2)
    frame = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    got = sorted((r.doc_id, r.page, r.error is None) for r in media.page_rows(frame).collect())
    assert got == [(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, False)]


def test_line_dedup_matches_definition(docs, rows):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    seen = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (seen[key(x)] >= 10)]
        want[r[0], "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = Counter((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs).collect())
    assert got == want


def test_mixing_reaches_targets(docs, rows):
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * size[s] if s in capped else level * weight[s] for s in order}
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    source = {}
    for r in rows:
        source.setdefault((size[r[3]], round(target[r[3]], 6)), r[3])
    taken = Counter()
    for r in got:
        taken[source[r.source_size, round(r.target, 6)]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


@pytest.mark.parametrize("block", [305, 4096])
def test_mixing_reaches_targets_of_sources_under_a_block(spark, block):
    sizes = {"a": 1_500_000, "b": 150, "c": 400, "d": 1, "e": 4097, "f": 611}
    made = [(100 * k + j, "w " * (n // 10 + (j < n % 10)), s) for k, (s, n) in enumerate(sizes.items()) for j in range(10)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string"), block=block).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 3 * r.size
    assert set(target) == set(sizes.values()) and all(abs(taken[n] - target[n]) <= 0.5 for n in target)


def test_the_schedule_places_documents(docs, rows):
    """Slots by the points themselves: what a source's points in order give its blocks."""
    got = mixing.mix(docs, block=7).collect()
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size and r.slots]
        assert all(r.slots == sorted(r.slots) and r.first_slot == r.slots[0] and len(r.slots) <= 4 for r in own)
        assert all((r.taken > 0) <= bool(r.slots) for r in got if r.source_size == source_size)
    sources = Counter()
    for r in rows:
        sources[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = {r.source_size: r.target for r in got}
    order = sorted(sources, key=lambda s: (s is None, s))
    need = {}
    for k, s in enumerate(order):
        goal, size = round(target[sources[s]]), max(1, sources[s])
        need[k] = goal // size * -(-size // 7) + -(-(goal % size) // 7)
    shares = {k: n + mixing.SPARE for k, n in need.items() if n}
    total, upto, edges = sum(shares.values()), 0, []
    for k, n in shares.items():
        upto += n
        edges.append((int(upto / total * mixing.POINTS) if k != max(shares) else mixing.POINTS, k))
    ranked = defaultdict(list)
    for slot in range(total):
        point = slot * mixing.GOLDEN % mixing.POINTS
        ranked[next(k for hi, k in edges if point < hi)].append(slot)
    firsts = {(k, slot): rank for k, own in ranked.items() for rank, slot in enumerate(own)}
    for r in got:
        if r.slots:
            k = next(k for k, s in enumerate(order) if sources[s] == r.source_size and (k, r.first_slot) in firsts)
            blocks = -(-r.source_size // 7)
            ranks = [firsts[k, slot] for slot in r.slots]
            assert ranks[0] < blocks and all((rank - ranks[0]) % blocks == 0 for rank in ranks) and ranks[-1] < need[k]


def test_mixed_documents_repeat_rows(docs):
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    kept = [r for r in mixing.mixed_documents(docs).collect()]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in kept)
    assert abs(words - taken) <= 8000 + 0.05 * taken


def test_mixed_documents_stand_in_the_order_of_the_schedule(spark):
    made = [(k, f"w{k} " * 50, "abc"[k % 3]) for k in range(300)]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string")
    first = {r.doc_id: r.slots for r in mixing.mix(frame).collect()}
    seen, order = Counter(), []
    for r in mixing.mixed_documents(frame).collect():
        order.append(first[r.doc_id][seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert order == sorted(order) and len(order) > 250


CLASHING = "doc_id long, text string, lang string, source string, gone string, gone_id string, gone_text string, hashed string, h string, n string, i string, c string, t string, slot string, slots string, _h string, w string"


def test_columns_with_clashing_names_come_back(spark):
    made = [(k, f"Shared line\nown line number {k} with some more words to it {k * 7}", "en", f"s{k % 2}", *(f"{c}{k}" for c in CLASHING.replace(" string", "").split(", ")[4:])) for k in range(12)]
    frame = spark.createDataFrame(made, CLASHING)
    for got in (line_dedup.drop_repeated_lines(frame).drop("n_lines", "n_dropped"), simhash.deduplicate(frame), mixing.mixed_documents(frame)):
        assert got.columns == frame.columns
        rows = {r.doc_id: r for r in got.collect()}
        assert rows and all(tuple(r)[4:] == made[k][4:] for k, r in rows.items())


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 0.0), (3, 20.0)], "k int, target double")
    got = [r.k for r in mixing.schedule(plan, 10_000).orderBy("slot").collect()]
    for upto in (100, 1000, 10_000):
        n = Counter(got[:upto])
        assert n[2] == 0 and all(abs(n[k] - upto * s) <= 6 for k, s in ((0, 0.5), (1, 0.3), (3, 0.2)))


def test_packing_covers_every_id(docs, rows):
    got = packing.pack(docs, WORDS, window=256).collect()
    tokens = Tokenizer.from_file(WORDS)
    want = Counter((r[0], tuple([*tokens.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    stream = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at, documents, open_ = 0, Counter(), []
    for r in stream:
        assert (r.sequence_id * 256 + r.offset, r.length) == (at, len(r.ids) // 2)
        ids = np.frombuffer(r.ids, "<u2")
        assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and r.start == len(open_)
        open_ += ids.tolist()
        at += r.length
        if len(open_) == r.doc_tokens:
            documents[r.doc_id, tuple(open_)] += 1
            open_ = []
    assert documents == want
    padded = {r.sequence_id: r for r in packing.pad(packing.pack(docs, WORDS, window=256), 256).collect()}
    assert all(len(r.ids) == 2 * packing.padded_length(r.n, 256) for r in padded.values()) and sum(r.n for r in padded.values()) == at


TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'.,!aeitshrnTE1é́ ßΣİ中😀")), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", "<|", " the ", "'re", "  ", "ing"])), max_size=6).map("".join))
def test_counts_match_the_library_at_every_prefix(text):
    library, own = Tokenizer.from_file(BYTES) if not CACHE else CACHE[0], token_counts.counter(BYTES)
    CACHE[:] = [library]
    want = [len(library.encode(text[:k], add_special_tokens=False)) for k in range(len(text) + 1)]
    assert own.count(text) == want[-1]
    assert own.prefix_counts(text) == want


CACHE: list = []


@pytest.mark.parametrize("letter", ["x", "日", "ß", "ab", "1", "Überseeschifffahrt"])
def test_counts_match_the_library_on_long_words_with_marks(letter):
    """Words of 1 to 300 bytes, bare or between marks: each way a segment is counted."""
    library, own = Tokenizer.from_file(BYTES), token_counts.counter(BYTES)
    for size in [*range(1, 8), *range(40, 60), 126, 127, 128, 200, 252, 253, 254, 255, 256, 257, 300]:
        word = (letter * size)[: max(1, size // len(letter[0].encode()))]
        for text in [word, *(word + mark for mark in ".,;:!?"), f"the {word}, and {word}! {word}'s", f"<|endoftext|>{word}.", f"({word})\n{word}"]:
            want = len(library.encode(text, add_special_tokens=False))
            assert own.count(text) == want, (letter, size, text[-3:])
            assert own.prefix_counts(text)[-1] == want


def test_token_counts_and_budgets(docs, rows):
    library = Tokenizer.from_file(BYTES)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False))
    want = Counter((r[0], len((r[1] or "").encode()), size(r[1]), size(r[1]) > 1024) for r in rows)
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, BYTES).collect()) == want
    for r in token_counts.truncate_to_budget(docs, BYTES, 7).collect():
        assert r.text is None or size(r.text) <= 7


def test_language_forward_sums_all_segmentations():
    pieces = ["▁".encode(), b"a", b"b", b"ab", b"ba", "▁a".encode(), b"aba"] + [bytes([k]) for k in range(256)]
    pieces = list(dict.fromkeys(pieces))
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    model = language.PieceModel(pieces, ["x", "y"], p)
    at = {q: k for k, q in enumerate(pieces)}

    def total(word, k):
        if not word:
            return 1.0
        return sum(p[at[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in at)

    got = model.score(["ab aba", "baab"])
    for text, row in zip(["ab aba", "baab"], got, strict=True):
        want = [sum(np.log(total(("▁" + w).encode(), k)) for w in text.split()) for k in (0, 1)]
        assert np.allclose(row, want)


def plain_sums(word, p, pieces):
    """Log sum over all segmentations of a word, by definition, in logarithms."""
    alpha = [0.0] + [None] * len(word)
    for i in range(1, len(word) + 1):
        terms = [alpha[j] + np.log(p[pieces[word[j:i]]]) for j in range(max(0, i - 48), i) if word[j:i] in pieces]
        alpha[i] = np.logaddexp.reduce(terms)
    return alpha


def plain_words(text):
    for part in (text or "").split():
        low = part.lower()
        keep = [k for k, c in enumerate(low) if unicodedata.category(c)[0] in "LM"]
        word = low[keep[0] : keep[-1] + 1] if keep else ""
        if any(unicodedata.category(c)[0] == "L" for c in word):
            yield ("▁" + word).encode()


def plain_model(labelled, vocabulary, rounds=4, smoothing=0.05):
    start = np.exp(-1.5 * np.array([len(x) for x in vocabulary]))
    at = {x: k for k, x in enumerate(vocabulary)}
    out = {}
    for lang in sorted({lang for _, lang in labelled}):
        p, counts = start / start.sum(), Counter(w for t, own in labelled if own == lang for w in plain_words(t))
        for _ in range(rounds):
            expected = np.full(len(vocabulary), smoothing)
            for word, n in counts.items():
                ahead = plain_sums(word, p, at)
                behind = plain_sums(word[::-1], p, {x[::-1]: k for x, k in at.items()})[::-1]
                for j in range(len(word)):
                    for i in range(j + 1, min(len(word), j + 48) + 1):
                        if (k := at.get(word[j:i])) is not None:
                            expected[k] += n * np.exp(ahead[j] + np.log(p[k]) + behind[i] - ahead[-1])
            p = expected / expected.sum()
        out[lang] = p
    return out, at


ODD = ["ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนและเป็นภาษาราชการของประเทศไทย", "我们认为这些真理是不言而喻的人人生而平等" * 6, "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft", "ψηφ" * 60, "the\tand\u00a0of", "½ ² ① Ⅷ 12 _ !", "x", "", None]


def test_language_model_matches_brute_force(spark):
    """Training and the whole query, word for word by definition: long words, scripts without blanks, no letters."""
    vocabulary = sorted({"▁".encode(), *(x.encode() for x in ("▁the", "the", "▁der", "er", "an", "▁an", "und", "schiff", "ภาษา", "ไทย", "我们", "不言而喻", "평", "ψη", "φψ"))}) + [bytes([k]) for k in range(256)]
    labelled = [("The and of the other " + ODD[0], "en"), ("der und die Fahrt " + ODD[2] + " " + ODD[3][:60], "de"), ("les et des bateaux " + ODD[1][:30], "fr")]
    model, (want, at) = language.fit(labelled, vocabulary), plain_model(labelled, vocabulary)
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.probability[:, k], want[lang], rtol=1e-9, atol=1e-15)
    texts = [*ODD, *(t for t, _ in labelled), " ".join(x or "" for x in ODD)]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(None, "und")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(frame, model).collect()}
    for k, text in enumerate(texts):
        words = list(plain_words(text))
        logs = np.array([sum(plain_sums(w, want[lang], at)[-1] for w in words) for lang in model.languages])
        odds = np.exp(logs - logs.max())
        letters = any(unicodedata.category(c)[0] == "L" for c in text or "")
        assert got[k].lang_pred == (model.languages[int(logs.argmax())] if letters else "und"), text
        assert abs(got[k].score - (odds.max() / odds.sum() if letters else 0)) < 1e-9


def test_unseen_letters_do_not_underflow():
    """48 bytes that no language has seen still differ between languages of different sizes."""
    pieces = ["▁".encode()] + [bytes([k]) for k in range(256)]
    p = np.full((len(pieces), 2), 1e-9)
    p[0], p[1 + ord("a")] = (0.9, 0.5), (0.1 - 2.6e-7, 0.5 - 2.6e-7)
    model = language.PieceModel(pieces, ["x", "y"], p)
    word = "ъ" * 22
    got = model.score([word, word * 3])
    assert np.allclose(got[:, 0] - got[:, 1], np.log(0.9 / 0.5)) and np.allclose(got[0], np.log(p[0]) + 44 * np.log(1e-9))


def test_language_accuracy_on_held_out_documents(spark):
    """Labels of documents that training may not see; the tables hold junk and misplaced copies too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, P.path("piece_bpe_32k.model"))
    rows = language.identify(docs.where(~language.learnable()), model).where("lang is not null and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_language_identification(spark, docs):
    made = [(k, ("der und ist nicht ein " if k % 2 else "the and of with this ") * 20, "de" if k % 2 else "en") for k in range(60)]
    model = language.train(spark.createDataFrame(made, "doc_id long, text string, lang string"), P.path("piece_bpe_32k.model"))
    got = {(r.doc_id, r.text): r for r in language.identify(docs, model).collect()}
    assert {r.lang_pred for r in got.values()} <= {"en", "de", "und"}
    letter = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    assert all((r.lang_pred == "und") == (not letter(r.text)) and 0 <= r.score <= 1 for r in got.values())
    assert got[203, "ein Wort und noch eins " * 2000].lang_pred == "de"
    assert all(r.lang_pred == "und" for r in language.identify(docs, None).collect())


def test_empty_tables(empty):
    model = language.train(empty, P.path("piece_bpe_32k.model"))
    assert model is None
    for frame in (
        simhash.near_duplicates(empty), simhash.deduplicate(empty), media.digests(media.store_texts(empty)), line_dedup.drop_repeated_lines(empty),
        mixing.mix(empty), mixing.mixed_documents(empty), packing.pack(empty, WORDS), token_counts.count_tokens(empty, BYTES), language.identify(empty, model),
    ):
        assert frame.count() == 0
