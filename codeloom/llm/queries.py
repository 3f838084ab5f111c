"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import ann, bitplane, bpe, ledger, licenses, minhash, packing, quality_lm, sharding, substring
from .common import table


def op1_bpe_round_trip(spark, sf_dir):
    return bpe.coded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_classifier(spark, sf_dir):
    return quality_lm.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark, sf_dir):
    return ledger.op3(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark, sf_dir):
    return minhash.op4(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark, sf_dir):
    return ann.op5(table(spark, sf_dir, "embeddings"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_bitplane_output(spark, sf_dir):
    return bitplane.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark, sf_dir):
    return substring.op8(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.op9(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.op10(table(spark, sf_dir, "documents"))


def queries():
    every = (op1_bpe_round_trip, op2_quality_classifier, op3_quality_rules, op4_minhash_near_dedup, op5_nearest_neighbours, op6_packing, op7_bitplane_output, op8_substring_dedup, op9_sharding, op10_license_scan)
    return {f.__name__: f for f in every}


def oracle_sql():
    return {"op3_quality_rules": ledger.oracle(), "op4_minhash_near_dedup": minhash.oracle(), "op8_substring_dedup": substring.oracle(), "op9_sharding": sharding.oracle(), "op10_license_scan": licenses.oracle()}
