"""Heat-and-health panel analytics on Spark: cleaning, exposure, matched odds ratios, reports."""
