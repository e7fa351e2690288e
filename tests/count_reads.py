"""Run queries in a session of their own and print the rows each one read, from the event log.

Usage: count_reads.py <log folder> <table folder> <query>...
"""

import json
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as contract  # noqa: E402

log, folder, *names = sys.argv[1:]
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.autoBroadcastJoinThreshold", "-1")
    .config("spark.eventLog.enabled", "true")
    .config("spark.eventLog.dir", log)
    .config("spark.eventLog.compress", "false")
    .config("spark.eventLog.rolling.enabled", "false")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
for name in names:
    spark.sparkContext.setJobDescription(name)
    contract.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
spark.stop()

query_of_stage, reads = {}, Counter()
for path in Path(log).iterdir():
    for line in path.read_text().splitlines():
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart":
            name = event["Properties"].get("spark.job.description")
            query_of_stage.update({stage: name for stage in event["Stage IDs"]})
        elif event["Event"] == "SparkListenerTaskEnd":
            reads[query_of_stage[event["Stage ID"]]] += event["Task Metrics"]["Input Metrics"]["Records Read"]
print(json.dumps(reads))
