from tallyloom.functions import fixed_values, scalars

__all__ = ["fixed_values", "scalars"]
