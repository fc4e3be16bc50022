"""Log analytics on Spark: reading, recognising, folding, searching, counting, paging and following log files of any size."""
