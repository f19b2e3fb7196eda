"""Join and windowing strategies that Spark has no operator for, as plans of built-in ones."""
