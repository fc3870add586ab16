"""Session settings shared by the tests, the bench and ad-hoc runs."""

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "millrace", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf keys may use __ for a dot."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    if master == "local" or master.startswith("local["):  # a cluster's own setting, or Spark's 200, otherwise
        settings["spark.sql.shuffle.partitions"] = "8"
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
