"""kbspark: knowledge-base analytics over tables, as plain DataFrame -> DataFrame functions on Spark."""
