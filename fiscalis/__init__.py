"""Public-finance analytics and text preparation on Spark."""
