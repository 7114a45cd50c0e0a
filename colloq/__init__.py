"""Conversation and document analytics expressed as Spark DataFrame plans."""

from colloq.session import build_session, cut

__all__ = ["build_session", "cut"]
