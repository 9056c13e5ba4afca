"""Ad-slot planning over whole catalogues of recordings, as plain Spark DataFrame functions."""
