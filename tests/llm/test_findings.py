"""Cases in which an operator once did less than the whole job."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lernwerk.llm import fingerprint, pii, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")

DE, NO, BE = "DE89 3704 0044 0532 0130 00", "NO9386011117947", "BE68539007547034"


def test_ibans_before_and_after_other_words(spark):
    bare = DE.replace(" ", "")
    texts = [f"IBAN {bare} BIC COBADEFFXXX", f"{DE} BIC: x", f"{DE} I said", f"{DE} 2024", f"\u00e9 \U0001f600 {DE}", f"{DE} COBADEFFXXX.", f"{NO} {BE}", f"AB12 {DE}", f"{DE}1 x", "AB12 CD34 EF56 GH78 IJ90"]
    want = [[bare], [DE], [DE], [DE], [DE], [DE], [NO, BE], [DE], [], []]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find(df).collect()}
    assert [found[i] for i in range(len(texts))] == want
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "IBAN [IBAN] BIC COBADEFFXXX" and clean[6] == "[IBAN] [IBAN]" and clean[9] == texts[9]


KEYED = [(None, "a b"), (None, "a b"), (None, "c\nd e"), (3, "x y z"), (3, "x y z"), (3, "x y z"), (1, None), (1, "long " * 30), (5, "c\nd e")]


def test_token_output_keeps_null_and_repeated_keys(spark):
    df = spark.createDataFrame(KEYED, "doc_id long, text string").repartition(3)
    encode = Tokenizer.from_file(PATH).encode
    want = Counter((k, tuple([*encode(t or "", add_special_tokens=False).ids, 1])) for k, t in KEYED)
    got = Counter()
    for r in token_output.pack(df, PATH, capacity=64).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            got[d, tuple(ids[a:b].tolist())] += 1
    assert got == want


@pytest.mark.parametrize("keyed", [KEYED, KEYED[3:], [(None, "p q"), (None, "r s t")]])
def test_fingerprints_keep_null_and_repeated_keys(spark, keyed):
    df = spark.createDataFrame(keyed, "doc_id long, text string").repartition(3)
    rows = fingerprint.compare_edited(df).collect()
    order = sorted(((k, t or "") for k, t in keyed), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    cut = lambda a, b: a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    want = Counter((k, len(t), hashlib.sha256(cut(t, n).encode()).hexdigest()) for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    single = spark.createDataFrame(list(enumerate(dict.fromkeys(t for _, t in order))), "k long, text string")
    of = {r.text: r.f for r in fingerprint.fingerprints(single.selectExpr("k", "text"), ["k"]).join(single, "k").select("text", fingerprint.hexed("fingerprint").alias("f")).collect()}
    near = Counter((k, of[t], of[t] == of[n]) for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.near_next == 1) for r in rows) == near
