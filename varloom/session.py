"""Session settings the operators count on, and the package for the workers."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# AQE measures shuffle sizes at run time: it broadcasts a side only when its measured
# size is under the threshold, and splits hot keys of a join over many tasks.
# forceOptimizeSkewedJoin keeps the split even where it costs one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application.

    The zip is made on the driver and handed out by Spark's own file service, so workers
    need no path of the driver.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="varloom-"), "varloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session and send it the package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark
