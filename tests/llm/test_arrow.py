"""Operators with Arrow kernels, against brute force on small tables with every awkward row."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from keyloom.llm import chaining, langid, packing, records, simhash
from keyloom.llm.components import connected_components
from keyloom.llm.queries import byte_bpe
from keyloom.llm.tokens import encoder

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(4000)]


def words(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def corpus():
    base = [" ".join(words(random.randint(20, 300))) for _ in range(30)]
    near = [b.replace(" ", "  ", 1) + " tail" for b in base[:8]]
    odd = [None, "", "  \n", "one", "two Words", base[0], base[0].upper(), " ".join(words(9000)), "é中😀\n\n x  y \n z", "<|endoftext|> text"]
    return list(enumerate(base + near + odd))


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "clash", 5) for i, t in CORPUS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bucket int, fingerprint string, start long").repartition(3)


def reference_print(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
    return root


def test_simhash_against_all_pairs(docs):
    prints = [reference_print(t) for _, t in CORPUS]
    own = components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].fingerprint for i, _ in CORPUS] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in CORPUS] == own
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(own)
    assert simhash.near_duplicates(docs.filter("false")).count() == 0


def test_simhash_rows_without_id_or_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s t u v")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 5 and collections.Counter(r.component_id for r in got) == {5: 4, None: 1}
    assert sorted((r.doc_id is None, r.text) for r in simhash.keep_one(df).collect()) == [(False, "a b c d e"), (True, "q r s t u v")]


@pytest.mark.parametrize("distance", [2, 4])
def test_links_are_all_pairs_within_the_distance(spark, distance):
    r = random.Random(distance)
    seeds = [r.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1, 1 << 63]
    values = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(12)} | set(seeds)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fingerprint long")
    got = [tuple(sorted(x)) for x in simhash.link_fingerprints(df, distance).collect()]
    want = {tuple(sorted((signed[a], signed[b]))) for a in values for b in values if a < b and (a ^ b).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_against_the_quadratic_recurrence():
    r = random.Random(3)
    for _ in range(40):
        m = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.randint(1, 25))]
        best, at = {}, sorted(set(m))
        for a, b in at:
            best[a, b] = 6.0 + max([0.0, *(best[x, y] - 0.1 * (a - x + b - y) for x, y in at if x < a and y < b)])
        got = chaining.chain(np.array([a for a, _ in m]), np.array([b for _, b in m]))[0]
        score = 6.0 * len(got) - sum(0.1 * (a2 - a + b2 - b) for (a, b), (a2, b2) in zip(got, got[1:]))
        assert score == pytest.approx(max(best.values()))
        assert all(a < a2 and b < b2 for (a, b), (a2, b2) in zip(got, got[1:]))


def test_passages(spark):
    plain, edited = words(80), None
    edited = [w if i % 13 else "changed" for i, w in enumerate(plain)]
    short = words(30)
    texts = [words(100) + plain + words(50), words(7) + plain, words(300) + edited + words(3), words(90) + short, short + words(90), words(200), words(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(7, " ".join(texts[6])), (8, None), (9, ""), (None, " ".join(plain)), (6, " ".join(texts[6])), (10, " ".join(["same"] * 4000)), (11, " ".join(["same"] * 4000))]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.source_id, r.doc_id) for r in got} - {(10, 11)} == {(0, 1), (0, 2), (6, 7)}
    by = {(r.source_id, r.doc_id): r for r in got}
    assert (by[0, 1].source_start, by[0, 1].source_end, by[0, 1].start, by[0, 1].end, by[0, 1].identity) == (100, 180, 7, 87, 1.0)
    assert abs(by[0, 2].start - 300) <= 2 and abs(by[0, 2].end - 380) <= 2 and by[0, 2].identity >= 0.9
    assert (by[6, 7].start, by[6, 7].end) == (0, 60)
    assert chaining.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    return [t.encode(text or "", add_special_tokens=False).ids for _, text in CORPUS], t


def test_pieces_encode_as_whole_texts():
    _, t = reference_ids()
    parts = ["a", "b", "'s", "'", ".", " ", "  ", "\n", " \n", "\t", "é", " ", "\x1c", "²", "Ⅷ", "1", "!!", "|", "<|endoftext|>", "́", "中", "😀", "_", "-", "\r\n", " ", "\x85", " A"]
    r = random.Random(2)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    coder = encoder(byte_bpe())
    for lo in range(0, len(texts), 400):
        coded, at = coder.encode(pa.array(texts[lo : lo + 400]).slice(0))
        got = [coded[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == [e.ids for e in t.encode_batch(texts[lo : lo + 400], add_special_tokens=False)]


def test_pieces_of_latin_words_marks_and_wide_spaces():
    _, t = reference_ids()
    parts = ["word", " Zoë", "façon,", "ñ.", "×", "÷", "\u3000", "\u2003", "\u00a0", "it's", "don't,", "(a)", "\n", "\n\n", " ", "  ", "é", "É!", "ß", "中。", "\ud7a3", "x" * 60, "_", "9", "\x1f", "\x7f"]
    r = random.Random(4)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    coder = encoder(byte_bpe())
    for lo in range(0, len(texts), 500):
        coded, at = coder.encode(pa.array([""] + texts[lo : lo + 500]).slice(1))
        assert [coded[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in t.encode_batch(texts[lo : lo + 500], add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(pa.array([], pa.string()))] == [[], [0]]


def test_records_round_trip(docs, tmp_path):
    ids, _ = reference_ids()
    manifest = records.write_records(docs, byte_bpe(), end_id=0, bytes_per_file=4000, rows_per_cell=9, folder=str(tmp_path / "out"))
    got, at = sorted(map(tuple, records.read_records(manifest).collect())), 0
    for (i, _), own, row in zip(CORPUS, ids, got):
        assert row == (i, at, len(own) + 1, zlib.crc32(np.array(own + [0], "<u4").tobytes()))
        at += len(own) + 1
    files = sorted((r.bucket, r.file) for r in manifest.collect())
    assert len(files) > 3
    raw = bytearray((tmp_path / "out" / "part-00001.rec").read_bytes())
    doc_id, first, end = records.read_record(bytes(raw), 0)
    assert first.tolist() == ids[doc_id] + [0] and records.read_record(bytes(raw), end)[0] == doc_id + 1
    for spot in (0, 9, 30):
        bad = bytearray(raw)
        bad[spot] ^= 1
        with pytest.raises(ValueError):
            records.read_record(bytes(bad), 0)


def test_records_of_nothing(spark, docs):
    assert records.read_records(records.write_records(docs.filter("false"), byte_bpe())).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "x y"), (3, "z")], "doc_id long, text string")
    assert [r.doc_id for r in sorted(records.read_records(records.write_records(odd, byte_bpe())).collect(), key=lambda r: r.start)] == [None, None, 3]


def test_packing(spark, docs):
    ids, _ = reference_ids()
    got = packing.pack(docs, byte_bpe(), end_id=1, window=256, opened=4, with_ids=True).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, _ in CORPUS:
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids[i] + [1]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and own[0].doc_tokens == len(ids[i]) + 1
    fill = []
    for w in windows.values():
        w = sorted(w, key=lambda r: r.offset)
        assert [r.offset for r in w] == np.cumsum([0, *(r.length for r in w)])[:-1].tolist()
        fill.append(sum(r.length for r in w))
    assert max(fill) <= 256 and sum(fill) / (256 * len(fill)) > 0.9
    assert packing.pack(docs.filter("false"), byte_bpe()).count() == 0


def test_open_windows_stay_bounded():
    r, packer, closed = random.Random(1), packing.BoundedPacker(100, 5), []
    items = [r.randint(1, 99) for _ in range(2000)]
    for i, n in enumerate(items):
        closed += packer.add(n, (i, n))
        assert len(packer.free) <= 5
    every = [x for w in closed + packer.rest() for x in w]
    assert sorted(every) == list(enumerate(items)) and all(sum(n for _, n in w) <= 100 for w in closed)


def test_languages(spark):
    words_of = {"en": "the and of with that this from have".split(), "de": "der und die mit das nicht ein auch".split(), "es": "el que los para una por con del".split(), "fr": "le les des dans une est pour avec".split()}
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(words_of[lang]) for _ in range(r.randint(5, 60))), lang) for i, lang in enumerate(sorted(words_of) * 150)]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !", "de"), (None, "the and of", None), (1003, "le les des", None)]
    got = langid.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()
    by = {x.doc_id: x for x in got}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i, _, _ in rows if by[i].held_out] == held
    assert sum(by[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.97
    assert all(by[i].lang_pred == "und" for i in (1000, 1001, 1002)) and by[None].held_out is False and by[1003].lang_pred == "fr"
    assert all(0 <= x.score <= 1 for x in got) and len(got) == len(rows) + 5
    assert {x.lang_pred for x in langid.identify(spark.createDataFrame(odd[-1:], "doc_id long, text string, lang string")).collect()} == {"und"}
