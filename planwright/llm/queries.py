"""The queries of this subpackage and their DuckDB SQL.

Operators without SQL here (media, tokens, repeats, classifiers, extraction, SimHash) are held against
brute force, exact round trips or held-out accuracy in the tests.  The pipeline of five of them is in
``corpus_pipeline.py``, which the driver's contract registers beside these."""

from . import filter_audit, gif_media, html_text, mixing, ngram_join, pieces, quality, repeats, secret_scan, simhash, spelling, spot_signatures, toxicity

QUERIES = {
    "op1_gif_media": gif_media.op1,
    "op2_spot_signatures": spot_signatures.op2,
    "op3_ngram_join": ngram_join.op3,
    "op4_source_mix": mixing.op4,
    "op5_sentencepiece": pieces.op5,
    "op6_repeats": repeats.op6,
    "op7_quality": quality.op7,
    "op8_html_text": html_text.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_toxicity": toxicity.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_simhash": simhash.op12,
    "op13_spelling": spelling.op13,
}

ORACLES = {
    "op2_spot_signatures": spot_signatures.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op4_source_mix": mixing.OP4_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
