"""mercato: commerce and advertising analytics as Spark DataFrame operators.

Three canonical fact tables (store order lines, search-ads report rows,
social-ads insight rows) feed a catalogue of named operators.  Every operator
is a function ``op(ctx, **params) -> DataFrame`` built from Spark SQL
expressions, joins, windows and aggregates so that Catalyst plans it and the
same call runs on a laptop sample or a cluster.
"""

from mercato.context import Context
from mercato.session import ensure_checkpoint_dir, get_spark

__all__ = ["Context", "get_spark", "ensure_checkpoint_dir"]
