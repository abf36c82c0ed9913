"""Token operators against the libraries, on texts made to be awkward."""

import hashlib
import random

import numpy as np
import public_tokenizers as vocab
import pytest
from tokenizers import Tokenizer

from lorefield.llm.bpe import ByteBPE, SpecialSplitter, TreeEncoder, load_bpe, load_prefix_counter, prefix_programs
from lorefield.llm.packing import LibraryEncoder, OpenBins, pack_best_fit
from lorefield.llm.tokens import block_steps, encode_tree, prefix_tables, token_budgets, write_prefix_tables

RANKS, JSON = vocab.path("byte_bpe_50k.tiktoken"), vocab.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", " ", "  ", "\n", "\t", " \n", "'s", "'", "'re", "r", "1", "22", "é", "ñandú", "!", "..", " ", "　", "中文", "xxxxx", "ing", "don't", "\x1c", "\x85", "😀", "<|endoftext|>", "ß"]
EDGE = [None, "", " ", "\n\n", "a" * 5000, "x y " * 3000, "<|endoftext|>", "<|endoftext|><|endoftext|> a", "same", "same"]


@pytest.fixture(scope="module")
def bpe():
    return load_bpe(RANKS, vocab.PATTERN)


def made(seed, n=300):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_prefix_tables_equal_encoding_every_prefix():
    counter, library = load_prefix_counter(JSON, vocab.PATTERN), Tokenizer.from_file(JSON)
    splitter = SpecialSplitter(counter.bpe.special)
    texts = made(1) + ["a" * 70 + " " * 40 + "b'll", "x" + "\x00", "x", "<|endof <|endoftext|>", " \n<|endoftext|> a"]
    for text, steps in zip(texts, block_steps(counter, splitter, texts)):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert np.concatenate([[0], np.cumsum(steps)]).tolist() == want


def test_many_pieces_at_a_time_equal_one_by_one():
    counter = load_prefix_counter(JSON, vocab.PATTERN)
    rnd = random.Random(8)
    pieces = sorted({bytes(rnd.choice(b"abcdeth \x00\xc3\xa9") for _ in range(rnd.randint(1, 32))) for _ in range(3000)})
    counts, size, _ = counter.tables.counts(pieces)
    for k, (piece, one) in enumerate(zip(pieces, prefix_programs(counter.bpe, pieces))):
        assert counts[k, : size[k] + 1].tolist() == one
        assert one[-1] == len(counter.bpe.piece(piece))


def test_tree_reduction_equals_encoding_whole(bpe):
    tree = TreeEncoder(bpe, leaf_chars=16)
    joins, join = [], tree.join
    tree.join = lambda *a: joins.append(a[2]) or join(*a)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(100, 2000))) for _ in range(30)]
    for text in made(3) + words:
        packed = tree.encode(text)
        assert packed == np.array(bpe.encode(text), "<u4").tobytes()
        assert tree.decode(packed, leaf_ids=4) == text.encode("utf-8")
    assert len(joins) > 2500  # every text of more than a leaf came from joins


def test_leaves_of_the_usual_size_are_joined(bpe):
    tree = TreeEncoder(bpe)
    joins, join = [], tree.join
    tree.join = lambda *a: joins.append(a[2]) or join(*a)
    text = "".join(made(11, 400))[: 10 * tree.leaf_chars]
    assert tree.encode(text) == np.array(bpe.encode(text), "<u4").tobytes() and len(joins) >= len(text) // tree.leaf_chars


def test_library_encoder_equals_library():
    own, library = LibraryEncoder(JSON, vocab.PATTERN), Tokenizer.from_file(JSON)
    for text in made(4) + [t for t in EDGE if t]:
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_bins_take_the_tightest_and_close_the_fullest():
    bins = OpenBins(10, 2)
    assert bins.put(7) == (0, 0)
    assert bins.put(5) == (1, 0)
    assert bins.put(3) == (0, 7)  # the tightest, not the first
    assert bins.put(8) == (2, 0)
    assert bins.put(9) == (3, 0)  # closes bin 2, the fullest
    assert bins.put(2) == (1, 5)
    assert bins.put(10)[1] == 0


def plain_best_fit(lengths, capacity, max_open):
    """Bins as a list, searched from end to end."""
    bins, places, n = [], [], 0  # [free, id, filled], oldest first
    for length in lengths:
        fits = [b for b in bins if b[0] >= length]
        if fits:
            tight = min(b[0] for b in fits)
            own = [b for b in fits if b[0] == tight][-1]
            bins.remove(own)
        else:
            own, n = [capacity, n], n + 1
        places.append((own[1], capacity - own[0]))
        own[0] -= length
        if own[0]:
            if len(bins) == max_open:
                least = min(b[0] for b in bins)
                bins.remove([b for b in bins if b[0] == least][-1])
            bins.append(own)
    return places


@pytest.mark.parametrize("capacity,max_open", [(10, 1), (10, 3), (64, 8), (1024, 50)])
def test_best_fit_equals_a_plain_version(capacity, max_open):
    rnd = random.Random(capacity)
    for _ in range(30):
        lengths = [rnd.choice([rnd.randint(1, capacity), rnd.randint(1, max(1, capacity // 5)), capacity]) for _ in range(300)]
        bins = OpenBins(capacity, max_open)
        assert [bins.put(n) for n in lengths] == plain_best_fit(lengths, capacity, max_open)


def test_packing_of_repeated_rows_and_long_texts(spark):
    library = Tokenizer.from_file(JSON)
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (None, None), (2, long), (3, "")], "doc_id long, text string").repartition(2)
    rows = pack_best_fit(df, JSON, vocab.PATTERN, 2, capacity=1024).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in df.collect())
    assert len([r for r in rows if r.doc_id == 1]) == 3 and len([r for r in rows if r.doc_id is None]) == 1
    own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 2)
    assert all(n == 1024 for _, _, n in own[1:]) and [s for _, s, _ in own] == [0] + [own[0][2] + 1024 * k for k in range(len(own) - 1)]


def test_special_strings_are_cut_leftmost_then_longest():
    splitter = SpecialSplitter({"<a>": 1, "<a><b>": 2, "<b>": 3})
    assert splitter.parts("x<a><b><b>") == ["x", "<a><b>", "", "<b>", ""]
    assert SpecialSplitter({}).parts("<a>") == ["<a>"]
    assert isinstance(load_bpe(RANKS, vocab.PATTERN), ByteBPE)


@pytest.fixture(scope="module")
def docs(spark):
    texts = EDGE + made(5, 40)
    return spark.createDataFrame([(i // 2 if i > 48 else i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, n_tokens string, ids int")


def test_counts_over_a_table(spark, docs):
    library = Tokenizer.from_file(JSON)
    tables = write_prefix_tables(docs, JSON, vocab.PATTERN)
    rows = [(d, t, [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)] if len(t) < 200 else [0, len(library.encode(t, add_special_tokens=False).ids)]) for d, t in ((r.doc_id, r.text or "") for r in docs.collect())]
    for limit in (0, 4, 512):
        got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_budgets(tables, limit).collect())
        assert got == sorted((d, len(t.encode()), counts[-1]) for d, t, counts in rows)
    cuts = sorted((r.doc_id, r.n_bytes, r.cut_chars) for r in token_budgets(tables, 4).collect() if r.n_bytes < 200)
    assert cuts == sorted((d, len(t.encode()), max(i for i, n in enumerate(counts) if n <= 4)) for d, t, counts in rows if len(t.encode()) < 200)
    assert token_budgets(prefix_tables(docs.limit(0), JSON, vocab.PATTERN), 4).count() == 0


def test_budgets_read_no_text(spark, docs, monkeypatch):
    """Counts come from the stored steps: the tables lack the texts, and nothing can encode."""
    tables = write_prefix_tables(docs, JSON, vocab.PATTERN)
    assert tables.columns == ["doc_id", "n_bytes", "width", "steps"]
    plan = token_budgets(tables, 512)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.replace(".text", "")
    steps = {r.doc_id: np.frombuffer(bytes(r.steps), np.int8 if r.width == 1 else "<i2") for r in tables.collect() if r.doc_id == 4}
    assert len(steps[4]) == 5000


def test_encoding_over_a_table(spark, docs):
    bpe = load_bpe(RANKS, vocab.PATTERN)
    got = sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in encode_tree(docs, RANKS, vocab.PATTERN).collect())
    assert got == sorted((r.doc_id, np.array(bpe.encode(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert encode_tree(docs.limit(0), RANKS, vocab.PATTERN).count() == 0


def test_packing_keeps_every_token_once_in_place(spark, docs):
    library = Tokenizer.from_file(JSON)
    unique = docs.dropDuplicates(["doc_id"]).repartition(3)
    rows = pack_best_fit(unique, JSON, vocab.PATTERN, 2, capacity=64, max_open=8).collect()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, bytes(r.ids)))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    for r in unique.collect():
        own = sorted(pieces[r.doc_id])
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(p[2] for p in own) == ids
        assert [p[0] for p in own] == list(range(len(own))) and all(len(p[2]) == 256 for p in own[1:])
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.2 * -(-total // 64) + 6
    assert pack_best_fit(docs.limit(0), JSON, vocab.PATTERN, 2).count() == 0


def test_hashes_of_ids(spark, docs):
    from pyspark.sql import functions as F

    row = encode_tree(docs.where("doc_id = 8"), RANKS, vocab.PATTERN).select("ids", F.sha2("ids", 256).alias("h")).first()
    assert row.h == hashlib.sha256(bytes(row.ids)).hexdigest()
