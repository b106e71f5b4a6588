"""DataFrame operators. Fitted ones are ML Estimator / Model pairs usable in a Pipeline."""
