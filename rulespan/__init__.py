"""Set-oriented evaluation of engineering standards, as Spark plans."""
