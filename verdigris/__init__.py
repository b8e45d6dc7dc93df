"""verdigris: evaluation analytics and corpus operations as Spark DataFrame plans."""
