import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelflow.llm import token_files
from panelflow.llm.common import shared_dir


@pytest.fixture(scope="module")
def spec():
    return token_files.public_spec()


def ids_of(spec, text):
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_whole_texts_come_back(odd_docs, spec):
    rows = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted(tuple(r) for r in token_files.round_trip(rows, spec).collect())
    want, start = [], 0
    for r in sorted(rows.collect(), key=lambda r: r["doc_id"]):
        ids = ids_of(spec, r["text"])
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_pieces_are_encoded_as_in_their_text(spec):
    texts = ["İstanbul ΣΑΣ Iİ é Ȩ́ x", "don't STOP  \t<|endoftext|> a b c\x1cd ́e", "", "   "]
    ids, counts = token_files.Encoder(spec).encode(texts, 2)
    assert np.split(ids, np.cumsum(counts))[:-1][0].tolist() == ids_of(spec, texts[0])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [ids_of(spec, t) for t in texts]


def test_random_access_without_copies(spark, spec):
    folder = shared_dir(spark)
    df = spark.createDataFrame([(i, "some words to fill a file " * 40) for i in range(30)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_files(df, spec, 2, folder, length=64).collect()
    assert sum(r["docs"] for r in manifest) == 30
    row = max(manifest, key=lambda r: r["tokens"])
    with token_files.open_file(folder, row["ids_path"]) as f:
        reader = pa.ipc.open_file(f)
        flat = np.concatenate(list(token_files.flat(reader)))
        assert len(flat) == row["tokens"] and flat.dtype == np.uint16
        ids, mask = token_files.sequence(reader, 3)
        assert (ids == flat[192:256]).all() and mask.all()
        last = (len(flat) - 1) // 64
        ids, mask = token_files.sequence(reader, last)
        assert mask.sum() == len(flat) - 64 * last


def test_odd_ids_and_empty_table(odd_docs, no_docs, spec):
    got = token_files.round_trip(odd_docs, spec).collect()
    assert len(got) == odd_docs.count()
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert token_files.round_trip(no_docs, spec).collect() == []


def test_ids_are_those_of_the_library_as_it_is_loaded(spark, spec):
    """Special tokens that texts spell, and marks that compose in lower case only."""
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    marks = [f"{c}{m}" for c in "JHTWYjhtwyAEé" for m in ("\u030c", "\u0331", "\u0308", "\u030a", "\u0307")]
    texts = ["a <|endoftext|> b", "x<|startoftext|>Y. <|ENDOFTEXT|> <|EndOfText|>a", "École ÉCOLE. Žluťoučký KŮŇ, İstanbul", "STOP <| x |>", "end.", *marks, " ".join(marks), *(f"a{m}b, {m}." for m in marks)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, start = [], 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.round_trip(df, spec).collect()) == want
    assert library.encode("<|endoftext|>", add_special_tokens=False).ids == [49407]


def test_random_strings_get_the_ids_of_the_library(spec):
    """Letters whose lower case ends in a mark, before marks; scripts, symbols, blanks and special tokens mixed."""
    import random

    import public_tokenizers

    library, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(8)
    own = token_files.Encoder(spec, spell_special=False)
    atoms = [*"abcABCiIİıßẞÀéñŉǰΐΰﬁŒæ", "İ", "TARİHİ", "Ḣ", "ẖ", "é", "\u0307", "\u0301", "\u0308", *".,;:!?'-_", "'s", "1", "42", "²", "漢", "ん", "д", "ع", "🙂", " ", " ", "\t", "\n", "\u00a0", "\u200d", "<|endoftext|>", "<|"]
    texts = ["TARİHİ.", "CUMHURİYETİ, 1923", "İ.", "aİ!b", *("".join(rng.choice(atoms) for _ in range(rng.randint(1, 12))) for _ in range(20_000))]
    ids, counts = own.encode(texts, 2)
    got = [x.tolist()[:-1] for x in np.split(ids, np.cumsum(counts))[:-1]]
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != library.encode(t, add_special_tokens=False).ids] == []


def test_vocabularies_that_reach_over_blanks_are_refused(no_docs, spec):
    import public_tokenizers

    token_files.check_spec(spec)
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f, pytest.raises(ValueError, match="blanks"):
        token_files.write_files(no_docs, f.read(), 2, "file:///tmp")


def test_query_agrees_with_the_library(spark):
    import public_tokenizers

    from panelflow.llm import queries

    sf, library = "/root/testdata/sf0.001", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op8_token_files(spark, sf).collect()) == want
