"""The registered queries of the corpus operators: columns, one row a row, and what can be worked out apart."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from cataloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontaminate": "doc_id bigint, item_id bigint, edits int, item_words int, similarity double, from_byte bigint, to_byte bigint",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_jaccard_join": "doc_id bigint, n_links bigint, n_copies int, rep_id bigint, component_id bigint, kept boolean",
    "op4_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    out = queries.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == COLUMNS[name]
    rows = out.collect()
    source = "pages" if name in ("op4_html_extraction", "op10_url_filter") else "embeddings" if name == "op6_embedding_dedup" else "documents"
    if name not in ("op1_decontaminate", "op11_hard_negatives", "op12_whitening"):
        assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    crc = lambda k: zlib.crc32(str(k).encode())
    if name == "op2_language_id":
        assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    if name == "op5_toxicity":
        assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    if name == "op7_suffix_dedup":
        assert all(r.n_bytes == len(texts[r.doc_id].encode()) for r in rows)
        assert all(r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows if not r.n_removed)
    if name == "op8_sharding":
        assert all(r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and 0 <= r.shard < 40 for r in rows)
        assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    if name == "op9_bpe":
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(queries.tokenizer_path())
        for r in rows:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    if name == "op13_sentencepiece":
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=queries.piece_path())
        for r in rows:
            ids = library.encode(texts[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
