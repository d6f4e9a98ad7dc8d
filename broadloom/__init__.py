"""Feature scaling, model selection and encoding of very wide numeric tables on Spark."""
