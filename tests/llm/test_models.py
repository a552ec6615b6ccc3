"""Language identification, quality rules, packing, language model and pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from stationwise.llm.common import table
from stationwise.llm.language_id import FILLER, LanguageConfig, dictionaries, labelled_sample, op1_language_id, with_language
from stationwise.llm.lm_scoring import ModelConfig, scored
from stationwise.llm.ngram_trie import EliasFano, Trie
from stationwise.llm.common import new_path, with_place_key
from stationwise.llm.packing import ChunkIds, PackingConfig, default_config, packed, sequences, shortest_pack_first, worker_coder
from stationwise.llm.quality_rules import QualityConfig, binomial_tail, certified_cutoffs, counts_of, judged

DATA = "/root/testdata/sf0.01"
ODD = ["", None, "  ", "a b", "  x  y   z", " lead", "trail ", "tr  ", "x\n y \n z", "n\n\n m", "t\tx", "<|endoftext|> a"]


# ---- language identification


def test_held_out_language_accuracy(spark):
    found = op1_language_id(spark, DATA).where("held_out").select("doc_id", "lang_pred", "score")
    truth = table(spark, DATA, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    rows = found.join(truth, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.n >= 60]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_the_sample_is_bounded_whatever_the_ids_and_copies(spark):
    """Null or repeated ids do not steer the sample; copies count once; very long texts give a piece."""
    texts = [f"le chat {'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]} dort" for k in range(300)]
    rows = [(None, texts[k % 300] if k % 3 else "toujours la meme phrase", "fr") for k in range(5_000)]
    rows += [(7, text, "de") for text in ("ein haus", "zwei haeuser", "x" * 50_000 + " drei haeuser")] * 50
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = LanguageConfig(sample_rows=100, sample_chars=500)
    drawn = labelled_sample(training, config)
    assert len(drawn["fr"]) == 100 == len(set(drawn["fr"])) and len(drawn["de"]) == 3
    assert {k: sorted(v) for k, v in drawn.items()} == {
        k: sorted(v) for k, v in labelled_sample(training.withColumn("doc_id", F.lit(1)).repartition(7), config).items()
    }
    assert max(map(len, drawn["de"])) <= 500
    found = with_language(training.limit(0).union(spark.createDataFrame([(1, "a" * 400_000, None)], training.schema)), training, "f")
    assert found.select("f.*").count() == 1
    assert labelled_sample(training.limit(0), config) == {}


def test_predictions_equal_plain_compression(spark):
    """The same dictionaries in a plain loop over compressors, whole text in pieces."""
    docs = table_of_documents(spark)
    config = LanguageConfig(sample_rows=40, dictionary_bytes=6_000)
    contents = dictionaries(labelled_sample(docs, config), config)
    wanted = {}
    for row in docs.collect():
        plain = " ".join("".join(c if c.isalpha() else " " for c in (row.text or "").lower()).split())
        pieces = [plain[i : i + config.piece_chars].encode() for i in range(0, len(plain), config.piece_chars)]
        if not pieces:
            wanted[row.doc_id] = "und"
            continue
        pieces[-1] += FILLER if len(pieces[-1]) < config.short_bytes else b""
        sizes = {}
        for lang, content in sorted(contents.items()):
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=config.level)
            coder = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes[lang] = sum(len(coder.compress(p)) for p in pieces)
        wanted[row.doc_id] = min(sizes, key=lambda lang: (sizes[lang], lang))
    found = with_language(docs, docs, "f", config).select("doc_id", "f.lang_pred").collect()
    assert {r.doc_id: r.lang_pred for r in found} == wanted


def table_of_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 2 = 0").select("doc_id", "text", "lang")


def test_language_of_odd_texts(spark):
    rows = [(i, x, "de" if i % 2 else "en") for i, x in enumerate(["the cat and the dog", "der Hund und die Katze"] * 8)]
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, x) for x in ODD[:3]] + [(2, "12 34"), (3, "und der Hund"), (None, "日本")], "doc_id long, text string")
    found = with_language(docs.withColumn("score", F.lit("x")), training, "found").select("doc_id", "text", "found.*").collect()
    named = {r.text: r for r in found}
    assert all(named[x].lang_pred == "und" and named[x].score == 0 and named[x].rejected for x in ["", None, "  ", "12 34"])
    assert named["und der Hund"].lang_pred == "de"
    unlabelled = training.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in with_language(docs, unlabelled, "f").select("f.*").collect()} == {"und"}
    assert with_language(docs.limit(0), training, "f").count() == 0


# ---- quality rules


def plain_counts(text):
    words = (text or "").encode().split()
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_plain_ones(spark):
    rng = random.Random(1)
    texts = [*ODD, "é日 x y\n#a#\n#a#", " ".join("ab"[rng.randrange(2)] for _ in range(400)), "r " * 30_000]
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(300))) for _ in range(40)]
    import pandas as pd

    found = counts_of(pd.Series(texts, dtype=object))
    for text, row in zip(texts, found.itertuples()):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == plain_counts(text)


def test_binomial_tail_and_cutoffs():
    for k, n, p in ((0, 5, 0.3), (3, 40, 0.05), (7, 7, 0.5), (20, 2000, 0.01)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert binomial_tail(k, n, p) == pytest.approx(exact)
    import pandas as pd

    counts = pd.DataFrame([("symbol_ratio", 0, 4000, 3), ("symbol_ratio", 5, 0, 90), ("upper_ratio", 13, 4000, 90)], columns=["rule", "steps", "good", "bad"])
    chosen = certified_cutoffs(counts, 10, QualityConfig())
    assert chosen["symbol_ratio"] == 0.04 and chosen["upper_ratio"] is None and chosen["mean_word"] is None


def test_certified_rules_keep_good_documents(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        words = [f"word{rng.randrange(900)}" + ("###" if bad else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en" if i % 3 else None))
        if i % 2 or bad:
            labels.append((i, 0 if bad else 1))
    rows += [(9000, None, "en"), (9001, "", None), (None, "w " * 20, "xx"), (5, rows[5][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("stratum", F.lit(0))
    labels = spark.createDataFrame([*labels, labels[3], (None, 1), (7, None)], "doc_id long, quality int")
    found = judged(docs, labels).collect()
    assert len(found) == len(rows)
    english = [r for r in found if r.doc_id is not None and r.doc_id < 3000 and r.doc_id % 3]
    assert all(r.kept == (r.doc_id % 10 != 0) for r in english)
    assert all(r.base_failed and not r.kept for r in found if r.doc_id in (None, 9000, 9001))
    assert judged(docs, labels.limit(0)).where("NOT base_failed AND NOT kept").count() == 0
    assert judged(docs.limit(0), labels).count() == 0


# ---- packing


def test_chunks_give_the_tokenizer_s_ids():
    coder = ChunkIds(Path(default_config().vocabulary).read_text(encoding="utf-8"), 50)
    rng = random.Random(2)
    parts = ["a", "B's", "don't", "é", "日本", " ", "  ", "\n", "\n\n", "\t", "12", "#$", " ", "x" * 300, ".", "they'll"]
    texts = [x or "" for x in ODD] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(30)) for _ in range(400)]
    for start in range(0, len(texts), 37):
        group = texts[start : start + 37]
        plain = [e.ids for e in coder.tokenizer.encode_batch(group, add_special_tokens=False)]
        assert [x.tolist() for x in coder.many(group)] == plain


def test_a_worker_keeps_its_frequent_chunks():
    vocabulary = Path(default_config().vocabulary).read_text(encoding="utf-8")
    coder = worker_coder(vocabulary, 1000, 20)
    rng = random.Random(5)
    for _ in range(4):
        texts = [" ".join([f"often{rng.randrange(15)}" for _ in range(40)] + [f"rare{rng.randrange(10**9)}"]) for _ in range(30)]
        assert [x.tolist() for x in coder.many(texts)] == [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        coder.shrink()
        assert 10 <= len(coder) <= 20 and all("often" in x for x in coder) and len(coder.starts) == len(coder.uses) == len(coder)
    assert worker_coder(vocabulary, 1000, 20) is coder


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_config().vocabulary)
    texts = ["<|endoftext|>", "one <|endoftext|> two", "a<|endoftext|>b c", "a <|endoftext| > b", "no such token here"] * 3
    expected = [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in expected[1] and 50256 not in expected[3]
    coder = ChunkIds(Path(default_config().vocabulary).read_text(encoding="utf-8"), 50)
    assert [x.tolist() for x in coder.many(texts)] == expected
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.ids_crc32 for r in packed(docs, default_config()).collect()}
    assert found == {i: zlib.crc32(np.array([*x, 1], dtype="<u4").tobytes()) for i, x in enumerate(expected)}


def test_plain_chunks_are_cut_as_the_tokeniser_cuts_them():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_config().vocabulary)
    coder = ChunkIds(Path(default_config().vocabulary).read_text(encoding="utf-8"), 3000, 500)
    rng = random.Random(31)
    alphabet = [*"aZ9 0,.$_'\"\n\n  ", "é", "Ñ", "×", "÷", "²", "½", "ж", "ӿ", "ʰ", "中", "\u0301", "\u00a0", "\u00ad", "😀", "'s", "the", "tion"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(6000)]
    texts += [f"{chr(c)} a{chr(c)} {chr(c)}b\n{chr(c)}1 .{chr(c)}" for c in range(32, 0x530) if c not in range(128, 160)]
    texts += ["word" * 500 + "'", ("ab1," * 300 + "\n") * 3 + "\u00d7"]
    for i in range(0, len(texts), 500):
        found = coder.many(texts[i : i + 500])
        assert [x.tolist() for x in found] == [x.ids for x in plain.encode_batch(texts[i : i + 500], add_special_tokens=False)]


def test_new_chunks_of_known_pieces_are_not_tokenised_again():
    coder = ChunkIds(Path(default_config().vocabulary).read_text(encoding="utf-8"), 3000)
    text = "Zworblefy, qqtion.\nZworblefy 1989 $$ qqtion"
    expected = coder.tokenizer.encode(f"{text} qqtion,$$\n1989", add_special_tokens=False).ids

    class Model:
        asked = []

        def tokenize(self, piece):
            self.asked.append(piece)
            return model.tokenize(piece)

    class Counting:
        model = Model()

    model, coder.tokenizer = coder.tokenizer.model, Counting()
    coder.many([text])
    Model.asked.clear()
    assert coder.many([f"{text} qqtion,$$\n1989"])[0].tolist() == expected
    # Only pieces that are no chunk by themselves; " qqtion" is one.
    assert Model.asked == [",$$", "\u010a", "1989"]


def test_resting_chunks_are_no_single_strings():
    vocabulary = Path(default_config().vocabulary).read_text(encoding="utf-8")
    coder = ChunkIds(vocabulary, 1000, 50)
    texts = ["many words many times\nand more é", "rare once", "many words é more", " many <|endoftext|>"] * 2 + ["single"]
    expected = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(3):
        assert [x.tolist() for x in coder.many(texts)] == expected
        coder.rest()
        coder.rest()
        assert len(coder) == 0 and "single" not in coder.resting.to_pylist() and "words" in coder.resting.to_pylist()


def test_patterns_use_the_histogram_and_fill_well():
    rng = random.Random(3)
    histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 2048), 900)}
    patterns = shortest_pack_first(histogram, 2048)
    used = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 2048 and count > 0
        for n in lengths:
            used[n] += count
    assert used == histogram
    packs = sum(c for _, c in patterns)
    assert packs <= 1.05 * math.ceil(sum(n * c for n, c in histogram.items()) / 2048)
    assert shortest_pack_first({}, 2048) == []


def test_pieces_lie_in_one_sequence_each(spark):
    config = PackingConfig(default_config().vocabulary, capacity=64)
    rows = [(i % 50, f"text number {i} " * (i % 23)) for i in range(400)] + [(None, "x"), (3, None), (3, None), (4, "y " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("row", F.lit("r"))
    found = packed(docs, config).collect()
    coder = ChunkIds(Path(config.vocabulary).read_text(encoding="utf-8"), 1000)
    expected = Counter()
    for doc_id, text in rows:
        ids = np.array([*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for at in range(0, len(ids), 64):
            piece = ids[at : at + 64]
            expected[doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) * 64 < 1.1 * sum(r.length for r in found)
    assert packed(docs.limit(0), config).count() == 0


def test_sequences_hold_the_documents_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_config().vocabulary)
    config = PackingConfig(default_config().vocabulary, capacity=64)
    rows = [(i, f"text number {i} <|endoftext|> " * (i % 23)) for i in range(200)] + [(1000, None), (1001, "y " * 500)]
    pieces = packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), config).cache()
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in sequences(pieces).collect()}
    assert all(0 < len(ids) <= 64 for ids in made.values())
    documents = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: r.start):
        documents[r.doc_id] += made[r.sequence_id][r.offset : r.offset + r.length]
    assert documents == {i: [*plain.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    assert sum(map(len, made.values())) == sum(map(len, documents.values()))
    last = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(rows[-2:], "doc_id long, text string"), DATA)
    assert all(len(r.ids) == 4 * r.length for r in last.collect())


# ---- language model


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for top, n in ((10, 0), (10, 5), (2**63, 70_000), (100, 1000), (1, 3)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        assert (EliasFano.encoded(values).decoded() == values).all()


def test_trie_answers_what_it_was_built_from():
    rng = np.random.default_rng(2)
    contexts, successors = rng.integers(2, 60, 5000, dtype=np.uint64), rng.integers(0, 90, 5000, dtype=np.uint64)
    trie = Trie.built(contexts, successors, np.ones(5000, dtype=np.int64))
    asked = np.array([(c, s) for c in range(70) for s in range(100)], dtype=np.uint64)
    places = trie.find_contexts(asked[:, 0])
    codes = trie.find_successors(places, asked[:, 1])
    seen = set(zip(contexts.tolist(), successors.tolist()))
    assert [(int(c), int(s)) in seen for c, s in asked] == (codes > 0).tolist()
    assert trie.totals.sum() == 5000 and trie.bytes < 5000 * 16
    empty = Trie.built(contexts[:0], successors[:0], contexts[:0])
    assert (empty.find_successors(empty.find_contexts(contexts), successors) == 0).all()


def test_scores_against_plain_counts(spark):
    rng = random.Random(6)
    words = ["W1"]
    for _ in range(6000):
        words.append(f"W{(int(words[-1][1:]) * 7 + rng.randrange(3)) % 400}")
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20]), i % 7 == 2) for i in range(300)]
    rows += [(None, "w1 w2", False), (900, None, True), (901, "", False), (5, rows[5][1], False), (902, "z" * 50_000, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(4).withColumn("block", F.lit(1))
    found = scored(docs, ModelConfig(block_tokens=700, shard_tokens=500)).collect()
    count, pairs = Counter(), defaultdict(Counter)
    tokens = {}
    for doc_id, text, held in rows:
        tokens[doc_id] = found_words = [*(text or "").lower().split(), "</s>"]
        if not held:
            count.update(found_words)
            for a, b in zip(["<s>", *found_words], found_words):
                pairs[a][b] += 1
    total, kinds = sum(count.values()), len(count)
    assert Counter(r.doc_id for r in found) == Counter(d for d, _, _ in rows)
    for r in found:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own))
        assert r.score < 0
    mean = {held: sum(r.score for r in found if r.held_out == held) / sum(r.n_tokens for r in found if r.held_out == held) for held in (True, False)}
    base = sum(r.base_score for r in found if r.held_out) / sum(r.n_tokens for r in found if r.held_out)
    assert mean[False] > mean[True] > base
    assert scored(docs.limit(0)).count() == 0


def test_shards_change_no_score(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(30)), i % 7 == 2) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    scores = [
        {r.doc_id: r.score for r in scored(docs, ModelConfig(block_tokens=600, shard_tokens=size)).collect()} for size in (60, 1_000_000)
    ]
    assert scores[0].keys() == scores[1].keys()
    assert all(scores[0][i] == pytest.approx(scores[1][i], abs=1e-9) for i in scores[0])
    assert all(r.score == 0 for r in scored(docs.withColumn("held_out", F.lit(True))).collect())


def test_chances_add_up_to_one(spark):
    vocabulary = [f"v{i}" for i in range(25)]
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(vocabulary[:20]) for _ in range(12)), False) for i in range(60)]
    asked = [(1000 + i, w, True) for i, w in enumerate(vocabulary)] + [(2000, "", True)]
    found = scored(spark.createDataFrame(rows + asked, "doc_id long, text string, held_out boolean"))
    known = {r.doc_id: r.score for r in found.where("held_out").collect()}
    ends = Counter(text.split()[-1] for _, text, _ in rows)
    assert len(ends) > 5
    # The chance of the first word: scores of one-word documents without their end.
    assert known[2000] < 0 and all(known[1000 + i] < 0 for i in range(25))


# ---- pipeline


def test_near_copies_leave_no_tables_behind(spark):
    """Only the numbered rows and the numbers of those that go stay for whoever writes the result."""
    folder = Path(new_path(spark, "probe")).parent
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i % 2]), "en", "web") for i in range(6)] + [(9, "another text", "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert {p.name.split("-")[0] for p in folder.iterdir() if p.name not in before} == {"rows", "later", "gone"}
    assert sorted(r.doc_id for r in left.collect()) == [0, 9]


def test_stages_copy_no_texts(spark, tmp_path):
    """Documents that are Parquet files are numbered where they lie; only slim tables of rows that go or stay are left."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i % 9, " ".join(words[: 60 - i % 3 % 2]), "en", "web" if i % 2 else None) for i in range(40)] + [(9, "another text", "en", "web")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    folder = Path(new_path(spark, "probe")).parent
    slim = {"exact_dedup": {"later", "gone"}, "near_dedup": {"later", "gone"}, "mixing": {"taken"}}
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        before = {p.name for p in folder.iterdir()} if folder.exists() else set()
        result = stage(spark, docs, DATA)
        assert {p.name.split("-")[0] for p in folder.iterdir() if p.name not in before} == slim[name]
        stored = stage(spark, docs.where("true OR rand() < 2").repartition(2), DATA)
        if name != "mixing":
            assert sorted(r.doc_id for r in result.collect()) == sorted(r.doc_id for r in stored.collect())
            assert result.count() == {"exact_dedup": 3, "near_dedup": 2}[name]
        else:
            assert result.count() > 0 and set(result.collect()) <= set(docs.collect())


def test_rows_are_keyed_by_their_place(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS doc_id", "'t' AS row_key", "'u' AS row_file").repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    one = sorted((tmp_path / "docs").glob("*.parquet"))[0]
    folder = Path(new_path(spark, "probe")).parent

    def keyed(frame):
        before = set(folder.iterdir()) if folder.exists() else set()
        found, key = with_place_key(frame)
        assert found.columns == [*frame.columns, key]
        keys = [r[key] for r in found.collect()]
        assert len(set(keys)) == len(keys) == frame.count()
        assert sorted(keys) == sorted(r[key] for r in found.select(key).where(F.col(key) >= 0).collect())
        return len(set(folder.iterdir()) - before if folder.exists() else ())

    assert keyed(docs) == 0 and keyed(spark.read.parquet(str(one))) == 0
    # Files read twice, parts of the rows, repeated rows, joined and other frames are stored.
    twice = spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs")
    again = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assert [keyed(x) for x in (twice, docs.limit(10), again, docs.unionAll(docs), spark.range(5), docs.withColumn("_metadata", F.lit(1)))] == [1] * 6


def test_pipeline_stages_on_awkward_documents(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, DATA, "documents").limit(250).collect()]
    rows += [rows[3], rows[3], (9001, None, None, None, None), (9002, "", "en", "s", 0), (None, rows[8][1], "en", None, 1)]
    rows += [(9003, rows[9][1].replace(" ", "  "), "en", "s", 1), (9004, rows[10][1] + " tail", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("row_key", "found", "language", "copies", "size", "key")}).repartition(3)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert docs.columns == names
        if name != "mixing":
            assert 0.8 * before < docs.count() < before
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {9001, 9002, 9003, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_mixing_stage_takes_whole_documents(spark):
    docs = table(spark, DATA, "documents")
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert mixed.join(docs, docs.columns, "left_anti").count() == 0
    words = lambda frame: {r.source: r.n for r in frame.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    had, taken = words(docs), words(mixed)
    order = sorted(had)
    level = sum(had.values()) / sum(1 + i % 3 for i in range(len(order)))
    largest = {r.source: r.n for r in docs.groupBy("source").agg(F.max(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert all(abs(taken[s] - min((1 + i % 3) * level, 3 * had[s])) <= largest[s] / 2 + 1 for i, s in enumerate(order))
