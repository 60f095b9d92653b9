import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers, trainers

from quillmill.constants import SPECIAL_TOKENS, SPLIT_PATTERN
from quillmill.functions import codec, text
from quillmill.functions.vocabulary import BYTE_LEVEL, BYTE_TO_ID, Vocabulary
from quillmill.operators.bpe_training import PairLedger, bpe_train
from quillmill.operators.vocabulary import (
    adjacent_pair_counts,
    merges_table,
    pretoken_counts,
    token_bytes_table,
    token_lookup,
    tokenize_with,
    vocab_lookup,
    vocab_minus_special,
    vocab_table,
)
from quillmill.sources.tokenizer_store import load_vocabulary, tokenizer_tables_read, tokenizer_tables_write

TRICKY = [
    "Hello world! This is a test.\nNumbers: 123, 4567, 89\nContractions: I'm, you're, it's\n"
    "Special chars: @#$%^&*()\nUnicode: 你好世界 🌍",
    "no break  space, line sep, CRLF\r\n\r\nend  ", "12345", "   three spaces", "tab\t\t", "", " ",
    "é combining", "'S 'll DON'T", "a<|bos|>b", "x" * 700 + "y", "ab" * 500,
]


def library_tokenizer(texts, size):
    tok = Tokenizer(models.BPE(byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(SPLIT_PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    tok.train_from_iterator(texts, trainers.BpeTrainer(
        vocab_size=size, min_frequency=0, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
        special_tokens=list(SPECIAL_TOKENS), show_progress=False))
    return tok


def library_merges(tok):
    model = json.loads(tok.to_str())["model"]
    return [(model["vocab"][a], model["vocab"][b]) for a, b in model["merges"]]


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    return [r["text"] for r in rows] + TRICKY[:6] + ["aaaa aaa aaaaa"] * 3


@pytest.fixture(scope="module")
def words(spark, sample):
    return pretoken_counts(spark.createDataFrame([(t,) for t in sample], "text string"))


@pytest.fixture(scope="module")
def vocab(words):
    return bpe_train(words, 500)


def test_training_equals_the_public_library(sample, vocab):
    tok = library_tokenizer(sample, 500)
    assert [m[:2] for m in vocab.merges] == library_merges(tok)
    assert vocab.size == tok.get_vocab_size() == 500
    assert [tok.token_to_id(name) for name in SPECIAL_TOKENS] == list(range(9))


@pytest.mark.parametrize("options", [
    {"forecast": 1}, {"forecast": 5, "rewrite_every": 3}, {"max_pairs": 400, "rewrite_every": 20},
])
def test_training_does_not_depend_on_batching(words, vocab, options):
    n = 265 + 60
    assert bpe_train(words, n, **options).merges == vocab.merges[:60]


@pytest.mark.parametrize("max_pairs", [8, 16, 64, 400])
def test_training_does_not_depend_on_the_pairs_held(spark, max_pairs):
    """Ties everywhere: sixty words of six letters, each once, merged until nothing is left."""
    r = random.Random(7)
    rows = sorted({"".join(r.choice("abcdef") for _ in range(6)) for _ in range(60)})
    words = spark.createDataFrame([(w, 1) for w in rows], "token string, n bigint")
    assert bpe_train(words, 330, max_pairs=max_pairs).merges == bpe_train(words, 330).merges


def test_training_reuses_tokens_with_equal_bytes_and_stops_when_nothing_is_left(spark):
    # "abc" arises from (ab, c) and from (a, bc)
    words = spark.createDataFrame([("ab", 50), ("bc", 40), ("abc", 9), ("zabcz", 3), ("qbcabc", 2)], "token string, n bigint")
    texts = [w for r in words.collect() for w in [r.token] * r.n]
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.train_from_iterator(texts, trainers.BpeTrainer(
        vocab_size=290, min_frequency=0, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
        special_tokens=list(SPECIAL_TOKENS), show_progress=False))
    ours = bpe_train(words, 290)
    assert [m[:2] for m in ours.merges] == library_merges(tok)
    assert ours.size < 290


def test_training_without_pairs(spark):
    assert bpe_train(spark.createDataFrame([("a", 3)], "token string, n bigint"), 300).merges == ()
    assert bpe_train(spark.createDataFrame([], "token string, n bigint"), 300).merges == ()
    with pytest.raises(ValueError):
        bpe_train(spark.createDataFrame([], "token string, n bigint"), 100)


def test_ledger_keeps_the_frequent_half():
    ledger = PairLedger({(i, i): i for i in range(1, 11)}, 0).trim(8)
    assert sorted(ledger.counts.values()) == [7, 8, 9, 10] and ledger.floor == 6
    ledger.apply([(10, 10, -10), (9, 9, -9), (8, 8, -8), (7, 7, -7)], new=99)
    assert ledger.best() is None


def test_encoding_equals_the_public_library(spark, sample, vocab):
    tok = library_tokenizer(sample, 500)
    texts = TRICKY + sample[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r.i: r.ids for r in df.select("i", codec.bpe_encode(F.col("text"), vocab, allow_special=True).alias("ids")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == tok.encode(t, add_special_tokens=False).ids, t[:40]


def test_special_text_is_plain_by_default(spark, vocab):
    df = spark.createDataFrame([("a<|bos|>b",), (None,)], "text string")
    plain = df.select(codec.bpe_encode(F.col("text"), vocab, prepend="<|bos|>", append=4).alias("ids")).collect()
    assert plain[0].ids[0] == 0 and plain[0].ids[-1] == 4 and all(i >= 9 for i in plain[0].ids[1:-1])
    assert plain[1].ids is None
    special = df.select(codec.bpe_encode(F.col("text"), BYTE_LEVEL, allow_special=True).alias("ids")).first().ids
    assert special == [BYTE_TO_ID[97], 0, BYTE_TO_ID[98]]


def test_round_trip_and_pieces(spark, vocab):
    df = spark.createDataFrame([(t,) for t in TRICKY], "text string")
    for v in (BYTE_LEVEL, vocab):
        back = df.select("text", codec.bpe_decode(codec.bpe_encode(F.col("text"), v), v).alias("back")).collect()
        assert all(r.text == r.back for r in back)
    pieces = df.select("text", text.pretokenize(F.col("text")).alias("p")).collect()
    assert all("".join(r.p) == r.text for r in pieces)
    assert df.filter("text = '12345'").select(text.pretokenize(F.col("text"))).first()[0] == ["12", "34", "5"]


def test_nested_encoding_equals_flat(spark, vocab):
    rows = [(1, ["one two", "", "drei"]), (2, []), (3, None), (4, ["four"])]
    df = spark.createDataFrame(rows, "k int, texts array<string>")
    nested = {r.k: r.ids for r in df.select("k", codec.bpe_encode_each(F.col("texts"), vocab, prepend=0).alias("ids")).collect()}
    flat = df.select("k", F.posexplode("texts").alias("p", "t")).select(
        "k", "p", codec.bpe_encode(F.col("t"), vocab, prepend=0).alias("ids")).collect()
    assert nested[2] == [] and nested[3] is None
    assert all(nested[r.k][r.p] == r.ids for r in flat)


def test_broken_utf8_decodes_to_replacement(spark):
    euro = [BYTE_TO_ID[b] for b in "€".encode()]
    df = spark.createDataFrame([([euro[0]],), (euro[:2],), (euro,), ([0, euro[1]],)], "ids array<int>")
    got = [r[0] for r in df.select(codec.bpe_decode(F.col("ids"))).collect()]
    assert got == ["�", "�", "€", "<|bos|>�"]


def test_byte_lengths(spark):
    a, b = BYTE_TO_ID[0xC3], BYTE_TO_ID[0xA9]
    v = Vocabulary(((a, b, 265), (BYTE_TO_ID[32], a, 266)))
    assert [v.n_bytes(i) for i in (0, a, 265, 266)] == [0, 1, 2, 2]
    assert [v.n_bytes(i, "decoded") for i in (0, a, 265, 266)] == [0, 3, 2, 4]
    assert token_bytes_table(spark, v).filter("n_bytes = 0").count() == 9


def test_tables_round_trip(spark, vocab, tmp_path):
    tokenizer_tables_write(spark, vocab, str(tmp_path))
    assert load_vocabulary(spark, str(tmp_path)) == vocab
    tables = tokenizer_tables_read(spark, str(tmp_path))
    assert tables["vocab"].count() == 500 and tables["merges"].count() == merges_table(spark, vocab).count()
    assert vocab_minus_special(tables["vocab"]).count() == 491


def test_lookups(spark):
    table = vocab_table(spark, BYTE_LEVEL)
    found = vocab_lookup(spark.createDataFrame([("a",), ("<|bos|>",), ("nope",)], "token string"), table)
    assert {r.token: r.token_id for r in found.collect()} == {"a": BYTE_TO_ID[97], "<|bos|>": 0, "nope": None}
    back = token_lookup(spark.createDataFrame([(0,), (BYTE_TO_ID[97],), (999,)], "token_id int"), table)
    assert {r.token_id: r.bytes and bytes(r.bytes) for r in back.collect()} == {0: b"<|bos|>", BYTE_TO_ID[97]: b"a", 999: None}


def test_pair_counts_and_any_tokenizer(spark):
    words = spark.createDataFrame([("aab", 2), ("b", 5)], "token string, n bigint")
    a, b = BYTE_TO_ID[97], BYTE_TO_ID[98]
    assert {(r.left_id, r.right_id): r.n for r in adjacent_pair_counts(words).collect()} == {(a, a): 2, (a, b): 2}
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    rows = tokenize_with(df, lambda: lambda t: [len(x) for x in t.split()]).collect()
    assert [r.ids for r in rows] == [[1, 1], None]


LETTERS = [BYTE_TO_ID[ord(c)] for c in "abc"]


def toy_vocab(rng):
    pool, merges = list(LETTERS), []
    for _ in range(rng.randrange(1, 30)):
        pair = (rng.choice(pool), rng.choice(pool))
        if pair not in {m[:2] for m in merges}:
            merges.append((*pair, 265 + len(merges)))
            pool.append(merges[-1][2])
    return Vocabulary(tuple(merges))


def brute(symbols, rules):
    while True:
        ranked = [(rules[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rules]
        if not ranked:
            return symbols
        _, i = min(ranked)
        symbols = symbols[:i] + [rules[(symbols[i], symbols[i + 1])][1]] + symbols[i + 2:]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", max_size=24), min_size=1, max_size=20), st.integers(0, 10**6))
def test_piece_merging_equals_brute_force(pieces, seed):
    vocab = toy_vocab(random.Random(seed))
    pool, start, size = codec.PieceEncoder(vocab)(pa.array(pieces))
    for piece, a, n in zip(pieces, start, size):
        symbols = [BYTE_TO_ID[b] for b in piece.encode()]
        want = brute(symbols, vocab.merge_rules)
        assert pool[a: a + n].tolist() == want
        assert codec.merge_symbols(symbols, vocab.merge_rules) == want
