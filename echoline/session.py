from pyspark.sql import SparkSession


def session(name: str = "echoline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries' semantics rest on."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.variant.allowDuplicateKeys": "true"}
    return builder.config(map=settings | conf).getOrCreate()
