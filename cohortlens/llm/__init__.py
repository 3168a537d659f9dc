"""Operators for preparing training text at scale, on their own: nothing else imports them."""
