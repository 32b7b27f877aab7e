"""The pipeline's rows against a chain of plain versions of its stages."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from test_matches import near_brute

from lexispark.llm import decontaminate, language_id, line_dedup, packing


def own_language(rows, model):
    """Texts whose best cosine reaches the least of its language and length."""
    kept = []
    for r in rows:
        x = language_id.counts(r["text"])
        v = np.log1p(x) * model.idf
        cosines = model.centroids @ (v / max(np.linalg.norm(v), 1e-9))
        band = int(np.log2(max(1, np.count_nonzero(v))))
        known = any(c.isalpha() for c in r["text"] or "")
        if known and cosines.max() >= model.reject[model.owner[int(cosines.argmax())], band]:
            kept.append(r)
    return kept


def without_site_lines(rows):
    pages, on = collections.Counter(r["source"] for r in rows), collections.Counter()
    for r in rows:
        on.update((r["source"], line) for line in set(r["text"].split("\n")) if line.strip())
    site = {k for k, n in on.items() if n > pages[k[0]] * line_dedup.RATIO and n >= line_dedup.LINE_PAGES}
    return [r | {"text": "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in site)} for r in rows]


def clean(rows, benchmark):
    items = decontaminate.Items.of(benchmark, 3, decontaminate.THRESHOLD)

    def copies(text):
        w = items.numbers(text)
        return any(2 * np.isin(w, x).sum() >= items.needs[k] and decontaminate.align(x, w)[0] >= items.needs[k] for k, x in enumerate(items.words))

    return [r for r in rows if not copies(r["text"])]


def pieces(rows):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for r in rows:
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[at : at + packing.CAPACITY]
            out[r["doc_id"], k] = (at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    return out


def test_pipeline_against_plain_stages(spark):
    sf = "/root/testdata/sf0.01"  # sources of some fifty pages, which have site lines
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    kept = own_language(rows, language_id.fit(docs))
    lines = without_site_lines(kept)
    classes = near_brute([(r["doc_id"], r["text"]) for r in lines])
    once = [r for r in lines if classes[r["doc_id"]][0] == r["doc_id"]]
    left = clean(once, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()])
    want = pieces(left)
    assert len(rows) >= len(kept) > len(once) > len(left) and any(a["text"] != b["text"] for a, b in zip(kept, lines, strict=True))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    at = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= packing.CAPACITY
