"""Logical schemas of the engine's tables, as DDL, and checks of a frame's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

RESIDUE_SCORES = "chain string, res_id int, res_name string, lddt double, plddt double, n_atoms int, ref_bfactor double, ref_bfactor_z double, rsa double, sse string, near_chain_gap boolean, coverage double"
MSA = "sequence string, source_database string, pairing_key string, comment string"
MSA_DEPTH = "candidate string, n_sequences int, neff double, neff_per_col double, length int, neff_estimated boolean"
TRAINING_IDENTITY = "candidate string, cutoff string, max_identity double, best_hit string, n_hits bigint, parse_failed boolean"
SEARCH_RESPONSE = "query_id string, result_type string, total_count bigint, result_set array<struct<identifier:string,score:double,services:array<struct<service_type:string,nodes:array<struct<node_id:int,original_score:double,norm_score:double,match_context:array<struct<sequence_identity:double,evalue:double,bitscore:int,alignment_length:int>>>>>>>>"
ENTRY = "rcsb_entry_info struct<nonpolymer_entity_count:int,resolution_combined:array<double>,deposition_date:string>, rcsb_accession_info struct<deposit_date:string,initial_release_date:string>, struct struct<title:string>, title string"
INVENTORY_CASE = "struct<target:string,condition:string,model_idx:int,predicted_path:string,reference_path:string,mapping_path:string,plddt_path:string>"
ATOMS = "model_idx int, chain string, res_id int, res_name string, atom_name string, x double, y double, z double, b_factor double"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df`, or a KeyError that names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df
