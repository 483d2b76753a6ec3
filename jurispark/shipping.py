"""Give the executors this package, for functions that run in their Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application (as ``--py-files`` would).

    The driver serves the archive itself, so no shared folder is needed.  Where the package is
    installed on the executors as well, nothing changes.
    """
    context = getattr(spark, "sparkContext", None)
    if context is None or context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="jurispark-")) / "jurispark-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
