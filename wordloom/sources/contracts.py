"""The tables' declared schemas, in one place: what a delivery must look like before it is read."""

from __future__ import annotations

from pyspark.sql import types as T

DECLARED = {
    "surface": "match_id string, search_key string, vocalized string, unvocalized string, corpus string, freq bigint, rank bigint, doc_freq bigint, pct double, cum_pct double, pos string, lemma string, root string, gloss_msa string, lane_root string, voc_source string, morph_confidence string, pos_agreement string, layers string, classical_keywords string, lane_entry_count int, divergence string, overlap_score double, loaded_at timestamp_ntz",
    "records": "id string, corpus string, record_type string, layer string, number int, displaynumber int, editionnumber int, kitab struct<idx: int, titlear: string>, bab struct<idx: int, titlear: string>, pages array<string>, textraw string, prev_id string, next_id string, seq bigint, curatedindex int, tokens int, numberscovered array<int>, crossrefs array<int>, zawaidnote string, loaded_at timestamp_ntz",
    "bindings": "record_id string, corpus string, leading_text string, tokens array<struct<i: int, surface: string, raw: string, matchid: string, binding: string, confidence: string, clickable: boolean, punctuationafter: string, tier: int>>, loaded_at timestamp_ntz",
    "witness": "witness_id string, edition string, number int, kitab_title string, text string, loaded_at timestamp_ntz",
    "entries": "nodeid string, root string, headword string, page int, nodenum int, forms array<string>, itypes array<string>, senses array<struct<label: string, level: string, runs: array<struct<t: string, v: string>>>>, loaded_at timestamp_ntz",
    "entries_raw": "raw_id bigint, root string, body string, loaded_at timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, url string, fetched_at timestamp_ntz",
    "mix_targets": "source string, target_share double, max_repeats int",
}


def contract(table: str) -> T.StructType:
    return T.StructType.fromDDL(DECLARED[table])
