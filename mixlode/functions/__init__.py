"""Driver-side mathematics on (k, d)-sized state."""
