import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cellgrove.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    tune(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid(spark):
    """Cells of numpy arrays: grid({image_id: {column: array}})."""

    def make(images):
        rows, kinds = [], {}
        for image, cols in images.items():
            h, w = next(iter(cols.values())).shape
            kinds = {n: "boolean" if a.dtype == bool else "double" for n, a in cols.items()}
            for y in range(h):
                for x in range(w):
                    rows.append((image, h, w, y, x, *[(bool if a.dtype == bool else float)(a[y, x]) for a in cols.values()]))
        schema = "image_id long, h int, w int, y int, x int, " + ", ".join(f"{n} {k}" for n, k in kinds.items())
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def back():
    """One column of one image back to an array."""

    def read(df, col, image=1):
        rows = df.filter(df.image_id == image).select("y", "x", col).collect()
        out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), None, dtype=object)
        for r in rows:
            out[r.y, r.x] = r[col]
        return out

    return read
