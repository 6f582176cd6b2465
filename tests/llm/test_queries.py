"""Every registered query of the corpus operators: the contract's columns, and SQL or a plain version of the digests."""

import hashlib
import re
import zlib

import pytest

import corpus_pipeline
from marketloom.llm import queries
from tests.oracle import connect, rows

#: Columns that the contract asks for, in its order.
COLUMNS = {
    "op1_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_quality": "doc_id held_out score predicted",
    "op3_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_minhash": "doc_id n_shingles component_id kept",
    "op7_hmm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_line_dedup": "doc_id",
    "op9_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op11_infill": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12_mixing": "doc_id size source_size target taken",
    "op13_dialogue": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, data, con, texts, name):
    got = queries.queries()[name](spark, data).toPandas()
    assert set(COLUMNS[name].split()) <= set(got.columns)
    if name in queries.oracle_sql():
        assert rows(got) == rows(con.execute(queries.oracle_sql()[name]).df())
        return
    assert sorted(got.doc_id) == sorted(texts)
    check = globals().get(f"_{name}")
    for r in got.itertuples():
        check(r, texts[r.doc_id] or "")


def _op1_webp(r, t):
    raw = t.encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    n = len(payload)
    mean = sum(payload) / n
    steps = sum(abs(a - b) for a, b in zip(payload, payload[1:], strict=False)) / (n - 1)
    assert r.feature.startswith(f"{n // 64}x64 mean={mean:.3f} ") and f"step={steps:.3f}" in r.feature


def _op2_quality(r, t):
    assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def _op5_toxicity(r, t):
    assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def _op7_hmm(r, t):
    assert r.held_out == (crc(r.doc_id, 10) == 0) and r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1
    assert r.n_known <= r.n_tokens and r.score < 0


def _op8_line_dedup(r, t):
    assert r.chars_before == len(t) >= r.chars_after


def _op9_sentencepiece(r, t):
    import sentencepiece

    global LIBRARY
    if "LIBRARY" not in globals():
        LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    ids = LIBRARY.encode(t, add_eos=True)
    assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _op10_license_scan(r, t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    assert (r.n_words, r.n_base) == (len(w), len(places))
    assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    if places:
        assert (r.first_word, r.last_word, r.score) == (min(places)[0], max(places)[0], 1.0)


def test_pipeline_is_registered(spark, data):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
