"""Operations of a training-data pipeline: each one a DataFrame operator, with its query in ``queries``."""
