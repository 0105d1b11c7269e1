"""Reward functions as column expressions, by the names configurations use."""

from rewardloom.rewards import answer, confidence, content, format  # noqa: F401
from rewardloom.rewards.base import REWARDS, Inputs, Reward, register

__all__ = ["REWARDS", "Inputs", "Reward", "register"]
