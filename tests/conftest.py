import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexiflow.session import get_session

    s = get_session(cpus="4", shuffle_partitions=4, app="lexiflow-tests")
    yield s


@pytest.fixture(scope="session")
def fixture_tokens(spark):
    """The 17-token hand fixture (two documents, shared unit ids)."""
    rows = [
        ("A_1", 0, "The ", "AT", "Untagged", 0, 0), ("A_1", 1, "cat ", "NN1", "Character", 1, 1),
        ("A_1", 2, "sat", "VVD", "Untagged", 2, 2), ("A_1", 3, ". ", "Y", "Untagged", 3, 3),
        ("A_1", 4, "The ", "AT", "Untagged", 4, 4), ("A_1", 5, "cat ", "NN1", "Character", 5, 5),
        ("A_1", 6, "ran", "VVD", "Narrative", 6, 6), ("A_1", 7, ".", "Y", "Untagged", 7, 7),
        ("B_1", 0, "In ", "II", "Reasoning", 0, 0), ("B_1", 1, "spite ", "II", "Reasoning", 0, 0),
        ("B_1", 2, "of ", "II", "Reasoning", 0, 0), ("B_1", 3, "it", "PPH1", "Untagged", 1, 1),
        ("B_1", 4, ", ", "Y", "Untagged", 2, 2), ("B_1", 5, "the ", "AT", "Untagged", 3, 3),
        ("B_1", 6, "cat ", "NN1", "Character", 4, 4), ("B_1", 7, "xyz", "FU", "Untagged", 5, 5),
        ("B_1", 8, ".", "Y", "Untagged", 6, 6),
    ]
    return spark.createDataFrame(rows, "doc_id string, token_idx bigint, token string, pos_tag string, "
                                       "ds_tag string, pos_id bigint, ds_id bigint")


@pytest.fixture(scope="session")
def fixture_corpus(fixture_tokens):
    from lexiflow.plans.corpus import Corpus

    return Corpus(fixture_tokens, single_token_pos=False)
