"""Search, linking and editing of markdown note collections on PySpark."""
