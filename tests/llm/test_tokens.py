"""Encoding, attribution, files and packing."""

import zlib

import numpy as np
import pytest
from edge_cases import edge_rows

from cohortpulse.llm import counts, packing, planes, tokens

VOCABULARY = tokens.vocabulary_path()
TEXTS = [r[1] or "" for r in edge_rows()] + [
    "", "  ", "İstanbul don't DON'T 12a3 é é x<|startoftext|> a_b ÷×¬ ß ẞ", "\x1c a\x1cb Ǆ ŉ 日本語 ａ ﬁ 'sabc x'll''s", "x\x85y​z कि", "\x00 a\x7f it's the 'tis"
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_ids_and_spans_equal_the_library_on_whole_texts(library, monkeypatch):
    ours = tokens.Encoder(VOCABULARY, spans=True)
    for text, want in zip(TEXTS, library.encode_batch(TEXTS, add_special_tokens=False)):
        ids, first, last = ours.spans(text.encode())
        assert ids.tolist() == want.ids == ours.ids(text.encode()).tolist()
        assert list(zip(first.tolist(), last.tolist())) == want.offsets
        assert ours.count(text.encode()) == len(want.ids)
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    for text in TEXTS:
        assert ours.ids(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded_by_bytes(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 5000)
    ours = tokens.Encoder(VOCABULARY)
    for k in range(30):
        text = "日本" * 400 + str(k)
        assert ours.ids(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(ours.words) <= 3


def test_other_vocabularies_are_left_to_the_library():
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    ours = tokens.Encoder(path, spans=True)
    assert not ours.by_words and tokens.Encoder(VOCABULARY).by_words
    for text in [*TEXTS, "Two  spaces\n\nand lines", " lead"]:
        want = other.encode(text, add_special_tokens=False)
        ids, first, last = ours.spans(text.encode())
        assert ids.tolist() == want.ids == ours.ids(text.encode()).tolist()
        assert list(zip(first.tolist(), last.tolist())) == want.offsets
        assert ours.count(text.encode()) == len(want.ids)


def test_attribution_rules():
    first, last = np.array([0, 3, 8, 12, 20]), np.array([3, 8, 12, 20, 21])
    begins, ends = np.array([0, 5, 10]), np.array([5, 10, 18])
    most, loose = counts.attribute(first, last, begins, ends, "most")
    # 3-8 goes to 5-10 (3 of 5), 8-12 is even and goes to the earlier, 12-20 to the last
    assert most.tolist() == [1, 2, 1] and loose == 1
    assert counts.attribute(first, last, begins, ends, "first")[0].tolist() == [2, 1, 1]
    shared, _ = counts.attribute(first, last, begins, ends, "shared")
    assert np.allclose(shared, [1 + 2 / 5, 3 / 5 + 1 / 2, 1 / 2 + 1])
    with pytest.raises(ValueError):
        counts.attribute(first, last, begins, ends, "last")


@pytest.mark.parametrize("rule", counts.RULES)
def test_section_counts_add_up(edge, library, rule):
    rows = counts.section_tokens(edge, VOCABULARY, rule).collect()
    sums = {}
    for r in rows:
        sums.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for r in rows:
        assert 0 <= r.first_char <= r.end_char
    want = sum(len(library.encode(t[1] or "", add_special_tokens=False).ids) for t in edge_rows())
    assert round(sum(r.n_tokens for r in rows)) == want


def test_sections_by_hand(spark, library):
    text = "word " * 300 + "\n\nanother line"
    got = counts.section_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), VOCABULARY).orderBy("section").collect()
    assert [(r.first_char, r.end_char) for r in got] == [(0, 1000), (1000, 1500), (1501, 1501), (1502, 1514)]
    assert [r.n_tokens for r in got] == [200, 100, 0, 2]


def test_field_tokens(spark, library):
    df = spark.createDataFrame([(1, "user", "Hello there", None), (2, None, None, "x")], "id long, role string, text string, note string")
    got = {(r.doc_id, r.field): r.n_tokens for r in counts.field_tokens(df, VOCABULARY, "id", ["role", "text", "note"]).collect()}
    assert got == {(1, "role"): 1, (1, "text"): 2, (1, "note"): 0, (2, "role"): 0, (2, "text"): 0, (2, "note"): 1}


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_planes_round_trip(kind, n):
    import io

    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    data = planes.planes_of(ids, kind, block=64)
    reader = planes.Reader(io.BytesIO(data), len(data))
    assert reader.ids(0, n).tolist() == ids.tolist()
    for start, size in ((n // 2, n - n // 2), (n // 3, n // 4)):
        assert reader.ids(start, size).tolist() == ids[start : start + size].tolist()
    with pytest.raises(IndexError):
        reader.ids(0, n + 1)
    with pytest.raises(ValueError):
        planes.Reader(io.BytesIO(data[:-1] + b"x"), len(data))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_hold_the_corpus_in_order(edge, library, tmp_path, kind):
    folder = str(tmp_path / "ids")
    index = planes.write_ids(edge, folder, VOCABULARY, block=1000, kind=kind)
    got = planes.read_documents(index, folder).join(planes.starts(index), "part").collect()
    ordered = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for r in ordered:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((at, r[0], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.before + r["at"], r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_best_fit_takes_the_tightest_window():
    assert list(packing.best_fit([8, 6, 4, 3, 2, 1], 10)) == [(0, 0), (1, 0), (1, 6), (2, 0), (0, 8), (2, 3)]
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 65, 500).tolist(), reverse=True)
    rooms: list[int] = []
    for length, (window, offset) in zip(lengths, packing.best_fit(lengths, 64)):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            assert rooms[window] == min(fitting) and offset == 64 - rooms[window]
        else:
            assert window == len(rooms) and offset == 0
            rooms.append(64)
        rooms[window] -= length


def test_packing_covers_every_id_once(edge, library):
    window = 64
    pieces = packing.pack(edge, VOCABULARY, window).collect()
    by_sequence, by_document = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_document.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert sum(p.length for p in pieces) == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in edge_rows())
    text = next(r[1] for r in edge_rows() if r[0] == 12)
    ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
    mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == 12)
    assert mine == [(s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes())) for s in range(0, len(ids), window)]


def test_nothing_from_nothing(empty, tmp_path):
    assert packing.pack(empty, VOCABULARY).count() == 0
    assert counts.section_tokens(empty, VOCABULARY).count() == 0
    index = planes.write_ids(empty, str(tmp_path / "none"), VOCABULARY)
    assert planes.read_documents(index, str(tmp_path / "none")).count() == 0


def test_every_plain_character_inside_a_word(library):
    ours = tokens.Encoder(VOCABULARY, spans=True)
    plain = [c for c in map(chr, range(0x250)) if c not in "\x85\xa0" and (tokens._PLAIN.fullmatch(c) or c.isalpha())]
    assert {"Ə", "Ɓ", "Ʌ"} <= set(plain)
    texts = [t for c in plain for t in (f"ma{c}li de", f"{c}li", f"li{c}", c)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids, first, last = ours.spans(text.encode())
        assert ids.tolist() == want.ids == ours.ids(text.encode()).tolist()
        assert list(zip(first.tolist(), last.tolist())) == want.offsets
