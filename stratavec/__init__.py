"""stratavec: tiered binary vector analytics and training-data operators on Spark."""
