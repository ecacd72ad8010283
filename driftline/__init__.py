"""Time-varying propensity scores from irregular trajectories, as Spark DataFrame plans."""
