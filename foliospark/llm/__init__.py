"""Training-data operators. Nothing outside this subpackage imports it, apart
from the guarded registration in ``__spark_entry__.py``."""
