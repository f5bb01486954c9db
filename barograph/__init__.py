"""barograph: daily market bars, timestamped sentiment and walk-forward research as Spark plans."""
