"""quarry: table-level analytics operators expressed as Spark plans.

Every operator takes DataFrames and returns DataFrames (or a small fitted
object plus a DataFrame).  Work is declared with the DataFrame/SQL API so
Catalyst prunes, pushes down and plans shuffles; Python runs only inside
Arrow-batched pandas functions where no built-in expression exists.
"""

from quarry.session import get_spark, checkpoint_dir, read_table

__all__ = ["get_spark", "checkpoint_dir", "read_table"]
