"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from jobmill.llm import ann, jaccard, langid, licenses, mixing, packing, quality, repair, repeats, segments, trie, urls, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_repeats": repeats.op2_repeats,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_quality": quality.op4_quality,
    "op5_segments": segments.op5_segments,
    "op6_langid": langid.op6_langid,
    "op7_packing": packing.op7_packing,
    "op8_ann": ann.op8_ann,
    "op9_urls": urls.op9_urls,
    "op10_warc": warc.op10_warc,
    "op11_mixing": mixing.op11_mixing,
    "op12_trie": trie.op12_trie,
    "op13_repair": repair.op13_repair,
}

ORACLES = {
    "op1_licenses": licenses.SQL,
    "op10_warc": warc.SQL,
    "op12_trie": trie.SQL,
    "op13_repair": repair.SQL,
}
