"""Level analysis queries."""

from pyspark.sql import functions as F

from wavelattice.operators import analysis
from wavelattice.plans.registry import query
from wavelattice.plans.tables import samples, samples_sql


@query(
    "probe_levels",
    f"""WITH {samples_sql()} SELECT clip_id, count(*) AS total_frames, max(abs(CAST(sample AS BIGINT))) / 32768.0::DOUBLE AS peak,
    round(sqrt(sum(CAST(sample AS DOUBLE) * sample) / count(*)) / 32768, 6) AS rms FROM s GROUP BY clip_id""",
)
def probe_levels(spark, sf_dir):
    return analysis.levels(samples(spark, sf_dir), 16).withColumn("rms", F.round("rms", 6))
