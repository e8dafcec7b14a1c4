"""Evidence analytics on Spark: DataFrame operators over operational evidence."""
