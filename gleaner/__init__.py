"""Review analytics on Spark: DataFrame-to-DataFrame operators over corpora of user reviews."""
