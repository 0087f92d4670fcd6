"""Compare registered queries with their SQL: python tests/check.py sf0.001 [name ...]"""

import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import connect, diff  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "/tmp/tidemark-checks")
    .config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
sf = f"/root/testdata/{sys.argv[1]}"
con = connect(sf)
q, o = entry.queries(), entry.oracle_sql()
wanted = sys.argv[2:]
names = [n for n in q if not wanted or n in wanted or any(w.endswith("*") and n.startswith(w[:-1]) for w in wanted)]
bad = 0
FLAGS = {
    "cartesian": r"CartesianProduct", "nested loop": r"BroadcastNestedLoopJoin", "python": r"(FlatMap|Map|Arrow|Batch)[A-Za-z]*(Pandas|Python|Eval)",
    "one-task window": r"Exchange SinglePartition[^\n]*\n[^\n]*\n?[^\n]*Window",
}
for n in names:
    t = time.time()
    try:
        df = q[n](spark, sf)
        if n in o:
            why = diff(df, con, o[n])
            note = "ok" if why is None else "DIFF " + why
        else:
            note = f"rows {df.count()}"
            why = None
    except Exception as e:  # noqa: BLE001
        why = note = "ERROR " + str(e).strip().replace("\n", " ")[:600]
        if os.environ.get("TB"):
            traceback.print_exc()
    if os.environ.get("PLAN") and why is None:
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = [k for k, v in FLAGS.items() if re.search(v, plan)]
        if re.search(r"Window \[.*\], \[(?!\w)", plan):
            found.append("window without key")
        note += f" {plan.count('Exchange')} exchanges" + (f" FLAGS {found}" if found else "")
    bad += why is not None
    print(f"{n:28s} {time.time() - t:6.2f}s {note}", flush=True)
print("bad:", bad, "of", len(names))
