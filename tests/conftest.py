import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tesserae.session import session

    s = session("tests", cores=8, partitions=8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


RECORDS = (
    "record_id long, source_dataset string, sample_id string, split string, image_path string, reference_image_path string, "
    "audio_path string, audio_feature_path string, text string, raw_text string, raw_label string, unified_emotion string, "
    "identity_id string, speaker_id string, valence double, arousal double, ingested_at timestamp"
)


@pytest.fixture(scope="session")
def records(spark):
    """records(**column=value) rows -> DataFrame of normalised records; what is not named is null."""
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def make(*rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RECORDS)

    return make
