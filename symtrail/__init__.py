"""symtrail: code-graph analytics as Spark DataFrame plans."""
