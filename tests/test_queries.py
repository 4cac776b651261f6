"""Registered queries against their oracles; ALL_QUERIES=1 checks every one."""

import os

import pytest
from oracle import DATA, compare, duck

import __spark_entry__ as entry

SF = f"{DATA}/sf0.001"
FEW = ["a01_scan_scene_lists", "a03_scan_images", "a04_csv_by_header", "a10_report_files", "c04_visual_choice", "c12_compare_pictures", "c22_board_resync", "e04_renumber", "e09_names_so_far", "e11_similarity_walk", "h17_prompts", "i01_split", "i02_merge", "i08_review_staging", "i09_note_reconcile", "j04_top_similar", "j05_similarity_columns", "j07_contact_tiles", "k01_incremental_intake", "k02_delivery_guard", "a13_url_intake", "b05_frame_manifest", "c13_dialogue_on_shots", "c16_invisible_audit", "d01_tier_tally", "d09_letterbox_rows", "d10_code_prefix", "d15_header_row", "e07_shots_from_scores", "g04_chunks_with_work", "h15_addressed_names", "i09_note_status", "i10_scrub_changes", "j06_near_duplicates", "m02_boundary_tolerance"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FEW


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
