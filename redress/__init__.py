"""redress: complaint analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` whose column
names, window length, thresholds and parameters are arguments.  Nothing is
collected to the driver inside an operator; callers decide when to act.

Sub-packages
------------
sources    reading the complaints table, the narrative CSV, and the view that
           derives a complaints table from the driver's TPC-H style tables
functions  small column-expression helpers and fixed lookup tables
operators  the analyses: counts, association, trends, outcomes, narratives,
           profile
plans      the full report and the registry of named queries
"""

from redress.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
